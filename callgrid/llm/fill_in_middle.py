"""Fill-in-the-middle by escaped marker injection, with DataFrame functions only.

A text is cut into units (runs of A-Z and a-z, else single code points). A delimiter is escaped in the text and then put
after every unit by one ``regexp_replace``; counting it counts the units, and ``substring_index`` takes prefix, middle
and suffix by the rank of their units. The parts are unescaped and put together with markers. Each row is worked on
alone, so there is no shuffle, and a text of any length costs time and memory in proportion to its length.

Cuts and forms are a hash of the doc_id, so reruns agree. ``restored`` rebuilds the text from output and form alone.

Defined results: a null text is an empty text, which stays plain; a null doc_id is hashed as an empty string; rows with
equal doc_ids are cut by the same hash; a text that holds a marker stays plain. Columns of the input stay, except those
whose names this operator gives to its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITER, ESCAPE = "\x1f", "\x1e"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are changed, and so many of the changed ones get the suffix first.
CHANGED, SUFFIX_FIRST, SEED = 90, 20, 1


def escaped(text: Column) -> Column:
    """The text without the delimiter; the escapes are no letters, so that they never join a run of letters."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(part: Column) -> Column:
    """What ``escaped`` was given, of a part with or without delimiters after its units."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The escaped text with a delimiter after each unit; an escape pair is one code point of the text, so one unit."""
    return F.regexp_replace(escaped(text), rf"[A-Za-z]+|{ESCAPE}[01]|[^A-Za-z]", "$0" + DELIMITER)


def units(marked: Column) -> Column:
    """Number of delimiters in a marked text."""
    return (F.octet_length(marked) - F.octet_length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def ranked(marked: str, first: str, last: str) -> Column:
    """The units after rank ``first`` up to rank ``last`` (names of columns), as they stand in the text."""
    return unescaped(F.expr(f"substring_index(substring_index({marked}, '\\u001f', cast({last} AS int)), '\\u001f', cast({first} - {last} AS int))"))


def draw(doc_id: Column, k: int, seed: int = SEED) -> Column:
    """The k-th number (from 1) of 32 bits that the seed and a document's id give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form. Texts that hold markers are plain, so each marker stands once."""
    body = F.substring_index(output, MIDDLE, 1)  # both other parts with the markers before them
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(F.substring_index(body, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(body, SUFFIX, -1))
    spm = F.concat(F.substring_index(body, PREFIX, -1), middle, F.substring_index(F.substring_index(body, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST,
                   seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` and n (units), form (plain, psm or spm), output, prefix_chars and middle_chars (null if plain)."""
    own = ["n", "form", "output", "prefix_chars", "middle_chars"]
    rows = docs.drop(*[c for c in own if c not in (doc_id, text)])
    kept, key = rows.columns, F.col(doc_id)
    rows = rows.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn("__marked", marked(F.col("__text")))
    rows = rows.withColumn("__n", units(F.col("__marked")))
    cuts = [draw(key, k, seed) % (F.col("__n") + 1) for k in (1, 2)]
    holds = F.col("__text").contains(PREFIX) | F.col("__text").contains(SUFFIX) | F.col("__text").contains(MIDDLE)
    form = F.when((F.col("__text") == "") | holds | (draw(key, 3, seed) % 100 >= changed), "plain").when(
        draw(key, 4, seed) % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumns({"__a": F.least(*cuts), "__b": F.greatest(*cuts), "__form": form, "__0": F.lit(0)})
    rows = rows.withColumns({
        "__prefix": ranked("__marked", "__0", "__a"), "__middle": ranked("__marked", "__a", "__b"),
        # the last delimiter stands after the last unit, so the whole text is one more piece
        "__suffix": unescaped(F.expr("substring_index(__marked, '\\u001f', cast(__b - __n - 1 AS int))")),
    })
    changes = F.col("__form") != "plain"
    out = {
        "n": F.col("__n"), "form": F.col("__form"),
        "output": assembled(*[F.col(f"__{c}") for c in ("form", "prefix", "middle", "suffix", "text")]),
        "prefix_chars": F.when(changes, F.length("__prefix")).cast("long"), "middle_chars": F.when(changes, F.length("__middle")).cast("long"),
    }
    return rows.select(*kept, *[v.alias(k) for k, v in out.items() if k not in kept])


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs).withColumn("restored", restored(F.col("output"), F.col("form")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {CHANGED} THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM cut
), parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                        WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""
