"""Compression quality classifier: zstandard dictionaries of good and bad text, calibrated size difference.

A text is cut into windows of ``WINDOW`` bytes (all of them, to its end); each is compressed with the dictionary built
from good and with the one built from bad labelled text. The difference of the two sums, per byte of text, and the
logarithm of the length go through a logistic calibration fitted on labelled texts that built no dictionary.

Fitting uses a bounded sample of the labelled rows: the ``PER_CLASS`` rows of each label with the smallest hash of
their doc_id, up to ``FIT_BYTES`` bytes of text in all. Scoring covers every row.

Defined results: null text is empty text. Labels that are null, or of doc_ids labelled both ways, are not used. With
no labels of one class the score is the other's share; with no labels at all it is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from callgrid.runtime import by_value, slices, stage

by_value(__name__)

WINDOW, DICT_BYTES, LEVEL, PER_CLASS, FIT_BYTES, SEED = 1024, 110 << 10, 3, 3000, 32 << 20, 5


def windows(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself serves."""
    samples = [w for t in texts for w in windows(t)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"\n" * 8


class Compressors:
    """The two compressors of a task."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=self._prepared(d), write_content_size=False, write_checksum=False,
            write_dict_id=False) for d in (good, bad)]

    @staticmethod
    def _prepared(data: bytes):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        return d

    def features(self, data: bytes) -> tuple[float, float]:
        """Size difference a byte (positive: the good dictionary fits better) and log length."""
        cut = windows(data)
        good, bad = (sum(len(c.compress(w)) for w in cut) for c in self.pair)
        return 20 * (bad - good) / max(1, len(data)), float(np.log1p(len(data)))


def design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x[:, 0], x[:, 1], x[:, 0] * x[:, 1]])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(texts: list[bytes], labels: list[int]) -> dict:
    """Model from labelled texts: every other text of a class builds its dictionary, the rest calibrate."""
    seen, share = set(labels), (sum(labels) / len(labels) if labels else 0.5)
    if len(seen) < 2:
        return {"constant": share}
    by_class = {k: [t for t, y in zip(texts, labels, strict=True) if y == k] for k in (0, 1)}
    dicts = {k: dictionary(v[::2]) for k, v in by_class.items()}
    rest = [(t, k) for k, v in by_class.items() for t in (v[1::2] or v)]
    both = Compressors(dicts[1], dicts[0])
    x = design(np.array([both.features(t) for t, _ in rest]))
    y = np.array([k for _, k in rest], float)
    weight = logistic(x, y)
    return {"good": dicts[1], "bad": dicts[0], "w": weight.tolist()}


def held_out(doc_id: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == which, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES) -> dict:
    """Fit on labelled documents (doc_id, text) and (doc_id, quality); ids, at most 2 x ``per_class``, are broadcast."""
    clean = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"),
        F.max("quality").alias("__most")).where("quality = __most")
    order = F.xxhash64(F.lit(SEED), "doc_id")
    sample = None
    for k in (0, 1):
        part = clean.where(F.col("quality") == k).orderBy(order, "doc_id").limit(per_class).select("doc_id", "quality")
        sample = part if sample is None else sample.unionAll(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id",
        "quality").agg(F.min("text").alias("text"))
    texts = stage(texts.withColumn("__at", order), "quality-sample")
    sizes = sorted((r["__at"], r["doc_id"], r["n"]) for r in texts.select("__at", "doc_id", F.octet_length("text").alias("n")).collect())
    left_out, room = [], fit_bytes
    for _, doc, n in sizes:  # only the texts that do not fit are left out
        if n <= room:
            room -= n
        else:
            left_out.append(doc)
    rows = texts.where(~F.col("doc_id").isin(left_out)).select("__at", "doc_id", "text", "quality").collect()
    rows.sort(key=lambda r: (r["__at"], r["doc_id"]))
    return fit([r["text"].encode() for r in rows], [r["quality"] for r in rows])


def score_quality(docs: DataFrame, model: dict, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (a column of that name gives way)."""
    kept = docs.drop(score)
    schema = StructType([*kept.schema.fields, StructField(score, DoubleType())])
    at = kept.columns.index(text)

    def run(batches):
        both = None if "constant" in model else Compressors(model["good"], model["bad"])
        for b in slices(batches, 1024):
            if both is None:
                p = np.full(b.num_rows, model["constant"])
            else:
                x = np.array([both.features((t or "").encode()) for t in b.column(at).to_pylist()]).reshape(-1, 2)
                p = 1 / (1 + np.exp(-np.clip(design(x) @ np.array(model["w"]), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, score])

    return kept.mapInArrow(run, schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit_quality(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
