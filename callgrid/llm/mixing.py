"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over permuted blocks.

Main path: DataFrame and SQL functions only. Each source's documents are dealt by hash into blocks of about
``BLOCK_WORDS`` words. A source's quota is the number of its blocks that make up its target; a source whose target is above
its size is passed several times, and each pass has a block order of its own. A binary tree splits the quota vector of a
node between two halves of its output shards: the left vector is a multivariate-hypergeometric draw, done by selection
sampling over hash-made uniforms, so that all quotas stay exact and reruns agree. A shard then draws its quota of each
source: the next blocks of the source's permuted order, which no other shard has. The last block that a pass draws is
taken in part, so that the words come to the target. The rows of a shard are shuffled by ``place``, a hash of row and pass.

Sizes follow the input: above ``MOST_BLOCKS`` blocks in all, blocks grow instead; there is a shard for each
``SHARD_WORDS`` words, ``LEAST_SHARDS`` at least and ``MOST_SHARDS`` at most. Gathered are the source catalogue (a row per
source), the order of one source's blocks, and a node's quota vector: a row with all sources, in ``PARTS`` parts. No task
holds more than these or one block. The plan is made from light rows; text moves when rows are drawn.

Defined results: null text has size 0; a null source is a source of its own, the last. With no words at all every
target is 0. Identical rows are dealt separately. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.llm.text import word_count
from callgrid.runtime import stage

WEIGHTS, LIMIT, SEED = (5, 2, 1), 3, 20260105
BLOCK_WORDS, MOST_BLOCKS = 1 << 14, 1 << 20
SHARD_WORDS, LEAST_SHARDS, MOST_SHARDS = 1 << 22, 16, 1 << 17
PARTS = 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(key, source_size, target) from (key, source_size): shares by weight, stopped at ``limit`` sizes, the excess reshared.

    The fixed point of the resharing is one level L with target = min(limit x size, weight x L). Sorted by the level at
    which each source stops, L follows from running sums.
    """
    everything = W.orderBy("key").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nth = F.row_number().over(W.orderBy("key"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((nth - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("key", "source_size", weight.alias("w"), F.sum("source_size").over(everything).alias("total"))
    stops = (limit * F.col("source_size") / F.col("w")).alias("stop")
    by_stop = W.orderBy("stop", "key")
    before = F.coalesce(F.sum(limit * F.col("source_size")).over(by_stop.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(by_stop.rowsBetween(0, W.unboundedFollowing))
    levels = ranked.select("*", stops).withColumn("level", (F.col("total") - before) / rest)
    free = F.min(F.when(F.col("stop") >= F.col("level"), F.struct("stop", "key", "level"))).over(everything)
    most = limit * F.col("source_size").cast("double")
    return levels.withColumn("free", free).select("key", "source_size", F.least(most, F.coalesce(F.col("w") * F.col("free.level"), most)).alias("target"))


def _sum(quotas: str) -> str:
    return f"aggregate({quotas}, 0L, (total, each) -> total + each.q)"


def _draw(quotas: str, drawn: str, salt: str) -> str:
    """SQL: array of (key, l, r), how many of each key a sample of ``drawn`` holds and leaves, drawn without replacement
    from ``quotas``, an array of (key, q). One by one, each is drawn with the share of those still due among those left."""
    uniform = f"(shiftrightunsigned(xxhash64({salt}, quota.key, nth), 11) / 9007199254740992D)"
    one = f"""aggregate(if(quota.q > 0, sequence(1L, quota.q), array()), named_struct('n', state.n, 'd', state.d, 'l', 0L),
        (draw, nth) -> if({uniform} * draw.n < draw.d, named_struct('n', draw.n - 1L, 'd', draw.d - 1L, 'l', draw.l + 1L), named_struct('n', draw.n - 1L, 'd', draw.d, 'l', draw.l)))"""
    return f"""aggregate({quotas}, named_struct('n', {_sum(quotas)}, 'd', {drawn}, 'out', cast(array() AS array<struct<key:string,l:bigint,r:bigint>>)),
        (state, quota) -> element_at(transform(array({one}), done -> named_struct('n', done.n, 'd', done.d, 'out', concat(state.out, array(named_struct('key', quota.key, 'l', done.l, 'r', quota.q - done.l))))), 1),
        state -> state.out)"""


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, key, quota) from (key, quota): the splitting tree, a level at a time. ``shards`` is a power of two.

    A node's vector is kept in parts of sources. Each split draws first how much of each part goes left, then how much of
    each source within its part, which is the same distribution as drawing from all sources at once.
    """
    parts = quotas.groupBy(F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("string").alias("key")).agg(F.sort_array(F.collect_list(F.struct("key",
        F.col("quota").alias("q")))).alias("quotas"))
    nodes = parts.agg(F.sort_array(F.collect_list(F.struct("key", "quotas"))).alias("parts")).select(F.lit(0).cast("long").alias("node"), "parts")
    level = 0
    while 2**level < shards:
        salt = f"{seed}, {level}, node"
        totals = f"transform(parts, part -> named_struct('key', part.key, 'q', {_sum('part.quotas')}))"
        left = _draw("totals", f"{_sum('totals')} div 2L", f"'part', {salt}")
        cut = f"transform(parts, (part, at) -> named_struct('key', part.key, 'cut', {_draw('part.quotas', 'get(lefts, at).l', salt)}))"
        side = lambda x: f"transform(cuts, part -> named_struct('key', part.key, 'quotas', transform(part.cut, each -> named_struct('key', each.key, 'q', each.{x}))))"
        nodes = nodes.withColumn("totals", F.expr(totals)).withColumn("lefts", F.expr(left)).select("node", F.expr(cut).alias("cuts"))
        nodes = nodes.select(F.explode(F.expr(f"array(named_struct('node', node * 2, 'parts', {side('l')}), named_struct('node', node * 2 + 1, 'parts', {side('r')}))")).alias("x")).select("x.node", "x.parts")
        level += 1
        if level % 6 == 0:  # enough nodes to spread, and an end to the growth of the plan
            nodes = stage(nodes.repartition("node"), "mix-nodes")
    flat = nodes.select(F.col("node").alias("shard"), F.explode(F.flatten(F.transform("parts", lambda p: p["quotas"]))).alias("x"))
    return flat.select("shard", "x.key", F.col("x.q").alias("quota"))


def sized(docs: DataFrame, text: str, source: str, identity: list[str], seed: int = SEED) -> DataFrame:
    """(row: all columns of ``docs``, key: the source with null last, size, at: a hash of identity and text)."""
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    at = F.xxhash64(F.lit(seed), *[F.col(c) for c in identity], F.xxhash64(text))
    return docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), word_count(F.col(text)).alias("size"), at.alias("at"))


class Plan(NamedTuple):
    """sources: (key, source_size, target, n_blocks); blocks: (key, block, passes: array of (pass, take, shard))."""

    sources: DataFrame
    blocks: DataFrame
    shards: int


def dealt(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns and their block."""
    return rows.join(sources, "key").withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "at"), F.col("n_blocks")))


def mix_plan(rows: DataFrame, weights=WEIGHTS, limit: int = LIMIT, shards: int | None = None, seed: int = SEED, block_words: int = BLOCK_WORDS) -> Plan:
    """The plan of (key, size, at) rows; further columns are not read."""
    light = rows.select("key", "size", "at")
    sources = stage(source_targets(light.groupBy("key").agg(F.sum("size").alias("source_size")), weights, limit), "mix-targets")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    block_words = max(block_words, -(-total // MOST_BLOCKS))
    shards = shards or min(MOST_SHARDS, max(LEAST_SHARDS, 1 << int(total // SHARD_WORDS).bit_length()))
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)))
    sizes = dealt(light, sources).groupBy("key", "block", "source_size", "target").agg(F.sum("size").alias("words")).where("words > 0")
    passes = stage(sizes, "mix-blocks").withColumn("pass", F.explode(F.expr(f"sequence(0, {limit - 1})")))
    passes = passes.withColumn("due", F.expr("greatest(0L, least(source_size, cast(round(target) AS bigint) - pass * source_size))")).where("due > 0")
    up_to = W.partitionBy("key", "pass").orderBy("place", "block").rowsBetween(W.unboundedPreceding, -1)
    passes = passes.withColumn("place", F.xxhash64(F.lit(seed + 2), "key", "pass", "block")).withColumn("before", F.coalesce(F.sum("words").over(up_to),
        F.lit(0)))
    due = passes.withColumn("take", F.expr("least(words, due - before)")).where("take > 0")
    due = stage(due.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy("pass", "place", "block")).cast("long")).select("key", "block",
        "pass", "take", "k"), "mix-due")
    shares = split_quotas(due.groupBy("key").agg(F.count("*").alias("quota")), shards, seed)
    end = F.sum("quota").over(W.partitionBy("key").orderBy("shard"))
    drawn = shares.withColumn("end", end).where("quota > 0").select("key", "shard", F.explode(F.expr("sequence(end - quota + 1, end)")).alias("k"))
    blocks = due.join(drawn, ["key", "k"]).groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "take", "shard"))).alias("passes"))
    return Plan(sources, stage(blocks, "mix-plan"), shards)


def mixed(rows: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """Rows with source_size, target and draws: an array of (pass, words, shard, place), one for each pass that takes words
    of the row. Rows lie in their block in the order of their hash, and a pass takes words up to its quota of the block."""
    in_block = W.partitionBy("key", "block").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt(rows, plan.sources).withColumn("before", F.coalesce(F.sum("size").over(in_block), F.lit(0)))
    draws = f"""filter(transform(coalesce(passes, array()), x -> named_struct('pass', x.pass, 'words', greatest(0L, least(size, x.take - before)),
        'shard', x.shard, 'place', xxhash64({seed + 3}, at, x.pass))), x -> x.words > 0)"""
    return placed.join(plan.blocks, ["key", "block"], "left").withColumn("draws", F.expr(draws)).select(*rows.columns, "source_size", "target", "draws")


def drawn_rows(rows: DataFrame, plan: Plan) -> DataFrame:
    """The mix: the columns of the documents, a row for each document and pass that takes words of it. Each shard is one
    partition, and its rows are in their shuffled order."""
    out = mixed(rows, plan).select("row", F.explode("draws").alias("draw")).select("row", "draw.shard", "draw.place")
    dealt_out = out.repartitionById(plan.shards, F.col("shard").cast("int")).sortWithinPartitions("place")
    return dealt_out.select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sizes = sized(docs, "text", "source", ["doc_id"]).select(F.struct("row.doc_id").alias("row"), "key", "size", "at")
    rows = stage(sizes, "mix-rows")  # light: no text
    out = mixed(rows, mix_plan(rows))
    return out.select("row.doc_id", "size", "source_size", "target", F.expr("aggregate(draws, 0L, (a, x) -> a + x.words)").alias("taken"), "draws")
