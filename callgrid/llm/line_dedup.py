"""Line dedup over levelled sorted runs of line hashes.

A document enters as the 128-bit hashes of its eligible lines. Batches of documents, by descending doc_id, are merged
against the runs: keys that no run holds are new, and their holder is the largest doc_id of the batch; of keys already
held only the count grows. Both form the batch's own sorted run on level 0; when a level has ``fanout`` runs they are
compacted into one run of the next level, which later batches meet.

Runs are tables in the shared folder, bucketed and sorted by the hash, with as many buckets as the session's shuffles have
partitions. So a batch is dealt once, for its own counts, and merging it with the runs moves no row of either; only a
compaction deals its runs anew. A batch has about ``BATCH_LINES`` lines; there are ``LEAST_BATCHES`` at least and ``MOST_BATCHES`` at most.

The text itself is read twice and shuffled once, by document, to take the lost lines out; runs hold hashes only. A line
that very many documents share is counted in two steps (each document once, then the partial counts), and the join that
finds its occurrences is split by adaptive execution, since both sides are staged tables.

Defined results: a null or empty text is one empty line. Lines whose key has fewer than ``min_chars`` code points
always stay. A null doc_id is a document of its own and the smallest. Rows that share a doc_id count as one document;
each keeps or loses its own lines. Blank is space, tab, LF, VT, FF, CR; only A-Z are lower-cased. Columns named like the
two results give way to them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.llm.text import BLANKS, LOWER, UPPER, let, lower_ascii
from callgrid.runtime import remove, shuffles_dropped, stage, staged_path

MIN_CHARS, MIN_DOCS, FANOUT = 20, 3, 3
BATCH_LINES, LEAST_BATCHES, MOST_BATCHES = 50_000_000, 5, 64


RUN = "h1 long, h2 long, n_docs long, first boolean, holder long"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def eligible_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """One row (id, tx, pos, h1, h2) per line that is long enough."""
    keys = F.transform(text_lines(F.col(text)), lambda line: lower_ascii(F.btrim(line, F.lit(BLANKS))))
    hashed = F.transform(keys, lambda k, i: F.when(F.char_length(k) >= min_chars, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"),
        F.xxhash64(F.lit("second"), k).alias("h2"))))
    lines = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tx"), F.explode(F.array_compact(hashed)).alias("x"))
    return lines.select("id", "tx", "x.pos", "x.h1", "x.h2")


class LineRuns:
    """Levelled sorted runs (h1, h2, n_docs, first, holder): first where the run's batch was the first to hold the key, and
    then holder is the largest doc_id (null: only rows without one)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.tables = spark, fanout, [], []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def met(self, own: DataFrame) -> DataFrame:
        """A batch's counts (h1, h2, n_docs, holder) as a run: first where no run holds the key."""
        own = own.withColumn("first", F.lit(True))
        for name, _ in self._runs():  # each holds a key at most once
            held = self.spark.table(name).select("h1", "h2", F.lit(True).alias("held"))
            own = own.join(held, ["h1", "h2"], "left").withColumn("first", F.col("first") & F.col("held").isNull()).drop("held")
        return own.select("h1", "h2", "n_docs", "first", F.when(F.col("first"), F.col("holder")).alias("holder"))

    @staticmethod
    def counted(lines: DataFrame) -> DataFrame:
        documents = F.count_distinct("id") + F.max(F.col("id").isNull().cast("int"))
        return lines.groupBy("h1", "h2").agg(documents.alias("n_docs"), F.max("id").alias("holder"))

    def add(self, lines: DataFrame) -> None:
        """Merge a batch (id, h1, h2) whose documents are all smaller than those added before."""
        self._store(self.met(self.counted(lines)), 0)

    def _runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def _store(self, run: DataFrame, level: int) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        name, path = f"line_run_{uuid.uuid4().hex}", staged_path(self.spark, f"line-run-{level}")
        with shuffles_dropped(self.spark):
            run.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name, format="parquet")
        self.tables.append((name, path))
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fanout:
            merged, self.levels[level] = self._merged(self.levels[level]), []
            self._store(merged, level + 1)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """One run of several. Read as plain files: a union of bucketed scans is not dealt by bucket."""
        union = self.spark.read.schema(RUN).parquet(*[path for _, path in runs])
        return union.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.bool_or("first").alias("first"), F.max("holder").alias("holder"))

    def index(self) -> DataFrame:
        return self._merged(self._runs())

    def drop(self) -> None:
        """Forget the tables and delete their files."""
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)
        self.levels, self.tables = [], []


def batch_bounds(lines: DataFrame, batches: int | None) -> list:
    """(above, upto) doc_ids of the batches, largest first; None is open."""
    n = lines.count()
    batches = batches or min(MOST_BATCHES, max(LEAST_BATCHES, -(-n // BATCH_LINES)))
    cuts = lines.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] if batches > 1 else None
    cuts = sorted({int(c) for c in cuts or []}, reverse=True)
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def shared_lines(spark: SparkSession, lines: DataFrame, min_docs: int, batches: int | None, fanout: int) -> DataFrame:
    """(h1, h2, holder) of the keys that at least ``min_docs`` documents hold."""
    runs = LineRuns(spark, fanout)
    try:
        for above, upto in batch_bounds(lines, batches):
            part = lines
            if above is not None:
                part = part.where((F.col("id") <= above) | F.col("id").isNull())
            if upto is not None:
                part = part.where(F.col("id") > upto)
            runs.add(part)
        return stage(runs.index().where(F.col("n_docs") >= min_docs).select("h1", "h2", "holder"), "line-shared")
    finally:
        runs.drop()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int
    | None = None, fanout: int = FANOUT, lines: str = "__lines", kept: str = "__kept") -> DataFrame:
    """All rows and columns of ``docs`` with two more: the number of lines before, and the 0-based numbers of the lines that
    stay."""
    docs = docs.drop(lines, kept)
    table = stage(eligible_lines(docs, doc_id, text, min_chars), "lines")
    shared = shared_lines(docs.sparkSession, table, min_docs, batches, fanout)
    lost = table.join(shared, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("holder"))).groupBy("id", "tx").agg(F.collect_set("pos").alias("lost"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(doc_id).cast("long").alias("own"), F.xxhash64(text).alias("own_tx"))
    joined = rows.join(lost, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_tx") == F.col("tx")), "left")
    n = F.size(text_lines(F.col("row")[text]))
    every = F.sequence(F.lit(0), n - 1)
    stay = F.when(F.col("lost").isNull(), every).otherwise(F.array_except(every, "lost"))
    return joined.select("row.*", n.cast("long").alias(lines), stay.alias(kept))


def kept_text(text: Column, kept: Column) -> Column:
    return let(text_lines(text), lambda lines: F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select(
        "doc_id", F.col("__lines").alias("n_lines"), (F.col("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col("__kept")), 256).alias("kept_sha256"),
    )


SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, rid, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
shared AS (SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT l.*, s.k IS NOT NULL AND l.doc_id <> s.holder AS lost FROM keyed l LEFT JOIN shared s ON l.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id, rid
"""
