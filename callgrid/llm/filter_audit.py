"""Filter interaction audit: what each filter of a set removes, in every order in which they can be applied.

A document is a mask of the filters it fails. A table of masks by orders, computed once, holds the step at which a
document of that mask falls: ``mapInArrow`` looks up all orders of a batch at once, ``np.bincount`` counts the falls by
part, order, step and label, and the arrays of all tasks are summed. All other counts follow from these.

Copies: whether a smaller doc_id holds the same text is found without a join on the text. Equal rows are counted first,
then each text has a row for each part, mask and label, which keeps its smallest doc_id; the smallest of a text's few
rows decides, so a text that a third of all documents share costs no more than any other.

Defined results: null text is empty text, null part is the empty string, a document without labels is neither good nor
toxic, one with several label rows is good (toxic) if any says so. A null doc_id is compared with none, so it never
counts as a copy, and makes no other row one. Rows with the smallest doc_id of a text all stay. No documents, no rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.llm.text import WORD
from callgrid.runtime import by_value, slices, stage

by_value(__name__)

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Labels of a document, counted apart: good and toxic are bits of this number.
LABELS = 4
#: Parts whose arrays a task holds at a time; more leave early, as further partial arrays.
HELD_PARTS = 256


def first_failures(filters: str = FILTERS, orders: list[str] = ORDERS) -> np.ndarray:
    """The step (from 0) at which a document falls, by mask and order; the number of filters, if it falls at none."""
    found = np.full((1 << len(filters), len(orders)), len(filters), np.int64)
    for column, order in enumerate(orders):
        for step in reversed(range(len(order))):
            bit = 1 << filters.index(order[step])
            found[(np.arange(len(found)) & bit) > 0, column] = step
    return found


FIRST = first_failures()
STEPS = len(FILTERS) + 1


def falls(mask: np.ndarray, label: np.ndarray, part: np.ndarray, n: np.ndarray, parts: int) -> np.ndarray:
    """Documents by part, order, step (the last: at none) and label, of rows that stand for ``n`` documents each."""
    cell = (part[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * STEPS + FIRST[mask]
    cell = cell * LABELS + label[:, None]
    weight = np.broadcast_to(n.astype(float)[:, None], cell.shape)  # whole numbers below 2**53 are exact
    counts = np.bincount(cell.ravel(), weight.ravel(), minlength=parts * len(ORDERS) * STEPS * LABELS)
    return counts.astype(np.int64).reshape(parts, len(ORDERS), STEPS, LABELS)


def _partial(held: dict) -> pa.RecordBatch:
    """For each part and order: all, good and toxic documents by step, one after the other."""
    counts = np.stack(list(held.values()))
    by = np.stack([counts.sum(-1), counts[..., 1] + counts[..., 3], counts[..., 2] + counts[..., 3]], axis=-2)
    flat = by.reshape(-1, 3 * STEPS)
    arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * 3 * STEPS), pa.array(flat.ravel()))
    names = [p for p in held for _ in ORDERS]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.tile(np.arange(len(ORDERS), dtype=np.int32), len(held))), arrays],
                                      names=["part", "order", "counts"])


def _removals(batches):
    held: dict[str, np.ndarray] = {}
    for b in slices(batches, 2048):
        parts = b.column(0).dictionary_encode()
        mask, label, n = (b.column(k).to_numpy() for k in (1, 2, 3))
        names = parts.dictionary.to_pylist()
        found = falls(mask, label, parts.indices.to_numpy(zero_copy_only=False), n, len(names))
        for name, counts in zip(names, found, strict=True):
            held[name] = held[name] + counts if name in held else counts
        if len(held) > HELD_PARTS:
            yield _partial(held)
            held = {}
    if held:
        yield _partial(held)


def audited(failures: DataFrame) -> DataFrame:
    """The audit of rows (part, mask, label, n), each of which stands for ``n`` documents alike."""
    rows = failures.select(F.col("part").cast("string"), F.col("mask").cast("long"), F.col("label").cast("long"), F.col("n").cast("long"))
    partial = rows.mapInArrow(_removals, "part string, order int, counts array<long>")
    summed = partial.groupBy("part", "order").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(3 * STEPS)])
    at = lambda kind, step: F.col(f"c{kind * STEPS + step}")
    left = lambda step: sum((at(0, s) for s in range(step + 1, STEPS)), F.lit(0))
    steps = F.array(*[F.struct(F.lit(s + 1).alias("step"), left(s).cast("long").alias("kept"), at(0, s).alias("removed"), at(1, s).alias("good_lost"),
                               at(2, s).alias("toxic_lost")) for s in range(STEPS - 1)])
    orders = F.array(*[F.lit(o) for o in ORDERS])
    rows = summed.select("part", F.element_at(orders, F.col("order") + 1).alias("filter_order"), F.inline(steps))
    rows = rows.withColumn("__letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    same = W.partitionBy("part", "__letter")  # 120 rows: the orders
    # At the first step falls whatever fails the filter, at the last what fails no other.
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(same)
    alone = F.max(F.when(F.col("step") == len(FILTERS), F.col("removed"))).over(same)
    return rows.select("part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), alone.alias("unique_fails"),
                       "good_lost", "toxic_lost", F.sum("removed").over(same).alias("shapley"))


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and the mask of the filters that need the document only (A to D)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), 0))
    rows = rows.withColumns({"n_words": F.size("words").cast("long"), "n_distinct": F.size(F.array_distinct("words")).cast("long")})
    tests = (
        F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 3 * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def document_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, label, n) of all documents, with the mask of all five filters.

    Label rows are staged, so that both sides of their join are plain shuffles, which Spark can split where a doc_id is
    hot; documents without an id need no label and stay out of it."""
    said = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).cast("int")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((said("quality") + 2 * said("toxic")).alias("label"))
    known = stage(known.where("label > 0"), "audit-labels")
    keys = ["doc_id", "digest", "part", "mask"]
    rows = own_failures(docs.where("doc_id IS NOT NULL")).groupBy(*keys).agg(F.count("*").alias("n"))
    rows = rows.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    alike = rows.groupBy("digest", "part", "mask", "label").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("n"))
    smallest = F.min("first.doc_id").over(W.partitionBy("digest"))  # a row for each part and label
    stay = F.when(F.col("first.doc_id") == smallest, F.col("first.n")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    both = F.array(F.struct("mask", F.col("stay").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("stay")).alias("n")))
    rows = alike.withColumn("stay", stay).select("part", "label", F.inline(both)).where("n > 0")
    unknown = own_failures(docs.where("doc_id IS NULL")).groupBy("part", "mask").agg(F.count("*").alias("n"))
    return rows.select("part", "mask", "label", "n").unionByName(unknown.select("part", "mask", F.lit(0).alias("label"), "n"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return audited(document_failures(docs, labels))


SQL = f"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN min(c.doc_id) OVER (PARTITION BY t) < c.doc_id THEN 16 ELSE 0 END AS mask
  FROM cut c LEFT JOIN said s ON c.doc_id = s.doc_id
), orders(filter_order) AS (VALUES {", ".join(f"('{o}')" for o in ORDERS)}), steps AS (
  SELECT filter_order, step, filter_order[step] AS letter, 1 << (ascii(filter_order[step]) - 65) AS bit,
         {" + ".join(f"CASE WHEN strpos(filter_order, '{f}') < step THEN {1 << k} ELSE 0 END" for k, f in enumerate(FILTERS))} AS before
  FROM orders, generate_series(1, 5) AS g(step)
), audit AS (
  SELECT part, filter_order, step, letter,
         count(*) FILTER (WHERE mask & (bit | before) = 0) AS kept,
         count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0) AS removed,
         count(*) FILTER (WHERE mask & bit > 0 AND mask & before > 0) AS redundant,
         count(*) FILTER (WHERE mask = bit) AS unique_fails,
         count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND good) AS good_lost,
         count(*) FILTER (WHERE mask & bit > 0 AND mask & before = 0 AND toxic) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM audit
"""
