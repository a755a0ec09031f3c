"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every window of five bytes gives six triplets that hold its first byte; tabulation hashing puts each into one of 256
buckets. A bucket is encoded by the quartile of its count among all buckets (two bits); a header holds the logarithm of
the length and the two quartile ratios. The difference of two digests is bounded, so likeness = 1 - difference / bound.

Neighbours: documents are range-partitioned by descending doc_id and sorted, so a task meets each document's next one
in its own stream. Only the first and last document of each partition are carried over the border, by a join on
partition numbers; whole texts are shuffled once.

Defined results: null text is empty text, whose digest has all buckets 0. Null doc_ids come last; rows with equal
doc_id are ordered by a hash of the text. A single document is its own next document. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.runtime import by_value, slices, stage

by_value(__name__)

BUCKETS, WINDOW = 256, 5
#: Offsets in the window of the two bytes that form a triplet with its first byte.
PAIRS = ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))
#: A difference is at most this: six for each bucket would be the worst, but unrelated texts stay near half of one.
BOUND = 1.6 * BUCKETS
STEP = (0, 1, 2, 6)


def _tables() -> np.ndarray:
    """Tabulation tables: three of 256 random bytes per triplet kind, from a fixed seed."""
    return np.random.Generator(np.random.PCG64(8)).integers(0, BUCKETS, (len(PAIRS), 3, 256), dtype=np.uint8)


TABLES = _tables()


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit. Texts of fewer than three bytes hit none; shorter windows at the end count too."""
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for (i, j), (first, second, third) in zip(PAIRS, TABLES, strict=True):
        n = len(b) - j
        if n > 0:
            counts += np.bincount(first[b[:n]] ^ second[b[i : i + n]] ^ third[b[j : j + n]], minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Digest as hex: length code, ratio nibbles, then two bits a bucket. Equal bytes give equal digests."""
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1,
        3 * BUCKETS // 4 - 1]])
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(((codes[:, None] >> np.array([1, 0], np.uint8)) & 1).ravel().astype(np.uint8)).tobytes()
    size = min(255, round(12 * math.log2(1 + len(data))) if data else 0)
    r1, r2 = (min(15, q * 15 // q3) if q3 else 0 for q in (q1, q2))
    return f"{size:02x}{r1:x}{r2:x}{body.hex()}"


def difference(a: str, b: str) -> float:
    """Bounded difference of two digests: 0 for equal ones, at most BOUND."""
    if a == b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(h[4:]), np.uint8)).reshape(-1, 2) @ np.array([2, 1], np.int64) for h in (a, b))
    body = int(np.array(STEP)[np.abs(x - y)].sum())
    head = abs(int(a[:2], 16) - int(b[:2], 16)) / 4 + sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (2, 3)) / 2
    return float(min(BOUND, body + head))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
STREAM = f"kind string, part int, text string, {RESULT}"
NAMES = [x.split()[0] for x in RESULT.split(", ")]
TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in RESULT.split(", ")]


def _row(doc_id, text: str, own: str, following: str, next_print: str) -> tuple:
    data = edited_text(text, following).encode("utf-8", "surrogatepass")
    changed = fingerprint(data)
    return doc_id, len(text), hashlib.sha256(data).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_print)


def _stream(batches):
    """Results of all documents but the partition's last; that one and the first leave as border rows with their texts."""
    part, before = TaskContext.get().partitionId(), None
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("text", pa.string()), *zip(NAMES, TYPES, strict=True)])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    border = lambda kind, doc: (kind, part, doc[1], doc[0], len(doc[1]), None, doc[2], None, None, None)
    for b in slices(batches):
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text or ""
            doc = doc_id, text, fingerprint(text.encode())
            rows.append(border("first", doc) if before is None else ("done", part, None, *_row(*before, doc[1], doc[2])))
            before = doc
        if rows:
            yield batch(rows)
    if before is not None:
        yield batch([border("last", before)])


def _borders(batches):
    for b in batches:
        d = b.to_pydict()
        rows = [_row(*x) for x in zip(d["doc_id"], d["text"], d["fingerprint"], d["next_text"], d["next_print"], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


def fingerprints_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every document and of its edit with the next one by descending doc_id (after the last: the first)."""
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = stage(rows.mapInArrow(_stream, STREAM), "fingerprints")
    firsts, lasts = out.where("kind = 'first'"), out.where("kind = 'last'")
    numbers = firsts.select("part")  # one small integer per partition
    links = numbers.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")),
        F.min("part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("next_part"))
    heads = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    ends = lasts.select("part", "doc_id", "text", "fingerprint").join(links, "part").join(heads, "next_part").select("doc_id", "text", "fingerprint",
        "next_text", "next_print")
    return out.where("kind = 'done'").select(*NAMES).unionByName(ends.mapInArrow(_borders, RESULT))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
