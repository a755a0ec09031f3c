"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing, each by its operator of callgrid.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``
and work on everything their predecessor kept. Between stages the rows are written as Parquet and read again.

Defined results. quality: rows with a score of 0.5 or more stay; null text is scored as empty text. line_dedup: shared
lines go, and n_chars (if there) follows the new text; null text stays null; a text that loses all lines is empty.
near_dedup: of each group one row stays, that of the smallest doc_id (rows without one come last, ties go to a hash of
the text, then of the row); rows without words all stay. mixing: a row is repeated once for each pass of the mix that
takes words of it and goes if none does; rows without words go; rows come in the shuffled order of their output shard.
packing: see the operator. Empty tables give empty results. Further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.llm import line_dedup, mixing, near_dedup, packing, quality
from callgrid.llm.text import BLANKS
from callgrid.runtime import scratch, staged_path

def unused(name: str, columns) -> str:
    """A column name that the documents don't have."""
    while name in columns:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model, score = quality.fit_quality(docs, labels), unused("score", docs.columns)
    return quality.score_quality(docs, model, score=score).where(F.col(score) >= 0.5).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, kept = (unused(x, docs.columns) for x in ("lines", "kept"))
    out = line_dedup.dedup_lines(docs, lines=lines, kept=kept)
    text = F.when(F.col("text").isNotNull(), line_dedup.kept_text(F.col("text"), F.col(kept)))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = near_dedup.near_duplicates(docs.select("doc_id", "text")).where("component IS NOT NULL")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("row_hash").alias("hash"))).alias("x"))
    key = ["hash", "id", "no_id"]
    first = first.select("x.hash", F.coalesce("x.doc_id", F.lit(0)).alias("id"), "x.no_id")
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), near_dedup.row_hash("doc_id", "text").alias("hash"), F.coalesce(F.col("doc_id").cast("long"),
            F.lit(0)).alias("id"),
        F.col("doc_id").isNull().alias("no_id"), (F.char_length(F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))) > 0).alias("words"),
    )
    hashable = [F.col(f"row.{f.name}") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    found = rows.where("words").join(first, key, "left_semi")
    kept = found.groupBy(*key).agg(F.min_by("row", F.xxhash64(*hashable)).alias("row"))  # repeated rows are one
    return kept.select("row").unionAll(rows.where("NOT words").select("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = mixing.sized(docs, "text", "source", ["doc_id"])
    return mixing.drawn_rows(rows, mixing.mix_plan(rows))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality", quality_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Compression, and the hashes that order the mix, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = staged_path(spark, f"pipeline-{name}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
