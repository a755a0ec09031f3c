"""Approximate nearest neighbours by an inverted multi-index, for the largest inner product.

The two halves of a vector are quantised separately by k-means; a pair of centroids is a cell. A query walks the pairs
in descending summed inner product with a heap over the two sorted centroid lists, until the cells it has met hold
``SHARE`` of all entries and ``LEAST_MET`` of them at least; the entries of those cells are reranked with their original vectors in double precision.

Equal vectors are one entry with the 21 smallest of their ids, which is enough for 20 exact neighbours besides the
query's own row, so a vector that a third of all rows hold costs one entry; equal queries are searched once. Cells are
laid into slots of at most ``SLOT`` entries, and a cell above that is cut by a hash, so every task multiplies one block
of queries with one slot. Each slot returns a query's best only, and the best of all slots come from a window that cuts
them in every task before they are shuffled. The index is fitted on the ``SAMPLE`` entries with the smallest key hash;
every row is indexed.

``SHARE`` trades work for recall. On vectors without any cluster structure, 64 numbers of length one, the 20 nearest are
spread over many cells: with 128 centroids for each half, a share of 0.1, 0.2, 0.3, 0.4 and 0.55 of 51,282 entries gives a
recall of 0.66, 0.82, 0.90, 0.95 and 0.98 (with 64: 0.61, 0.78, 0.87, 0.93 and 0.97). Clustered vectors need far less.
Work grows with the share, entries and queries; more centroids order the cells better, but the heap takes more steps.

Defined results: vectors that are null, empty, zero, of another length than most usable ones (ties: the longer), or hold
null or non-finite components take no part, nor do rows without vec_id. Without a usable vector nothing is found. Fewer candidates than asked for are all returned. Ties
go to the smaller vec_id. Repeated ids count once per vector.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.runtime import by_value, slices, stage

by_value(__name__)

NEIGHBOURS, EVERY, SAMPLE, MOST_CENTROIDS, SHARE, LEAST_MET, SLOT, QUERY_BLOCK, LLOYD, SEED = 20, 20, 20_000, 128, 0.4, 2000, 4096, 8192, 12, 6


def _vectors(column, size: int):
    """Positions and rows of the vectors that take part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = [(i, v) for i, v in enumerate(column.to_pylist()) if v and len(v) == size and None not in v]
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, size))
    at = np.array([i for i, _ in rows], np.int64)
    x = np.array([v for _, v in rows], np.float64) + 0.0  # -0.0 equals 0.0
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[ok], x[ok]


def _keys(x: np.ndarray) -> list[bytes]:
    import xxhash

    return [xxhash.xxh3_128_digest(r.tobytes()) for r in x]


def entries(vectors: DataFrame, size: int, keep: int) -> DataFrame:
    """(key, vec, ids): a row per distinct vector with its ``keep`` smallest ids, folded in each batch first."""

    def fold(batches):
        for b in batches:
            at, x = _vectors(b.column(1), size)
            ids, found = b.column(0).to_numpy(zero_copy_only=False), {}
            for i, k, v in zip(at, _keys(x), x, strict=True):
                found.setdefault(k, (v.tobytes(), set()))[1].add(int(ids[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array([v for v, _ in found.values()], pa.binary()),
                    pa.array([sorted(s)[:keep] for _, s in found.values()], pa.list_(pa.int64()))], names=["key", "vec", "ids"])

    parts = vectors.mapInArrow(fold, "key binary, vec binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return parts.groupBy("key").agg(F.min("vec").alias("vec"), ids.alias("ids"))


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct sample rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.Generator(np.random.PCG64(seed)).permutation(len(x))[:k]]
    for _ in range(LLOYD):
        near = nearest(x, c)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in descending first[i] + second[j], found with a heap, until they hold ``enough`` entries."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y, width = first[a].tolist(), second[b].tolist(), len(second)
    heap, cells, held, reach = [(-x[0] - y[0], 0, 0)], [], 0, [0] * len(a)
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        if counts[cell]:
            cells.append(cell)
            held += counts[cell]
        if j + 1 < width:
            heapq.heappush(heap, (-x[i] - y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-x[i + 1] - y[0], i + 1, 0))
    return cells


def lay_out(counts: np.ndarray, slot: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots of each cell: cells share a slot while they fit; a large one has several of its own."""
    first, pieces, at, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), -1, 0
    for cell, n in enumerate(counts.tolist()):
        if n > slot:
            pieces[cell] = -(-n // slot)
            first[cell], at, room = at + 1, at + int(pieces[cell]), 0
        else:
            if n > room:
                at, room = at + 1, slot
            first[cell], room = max(at, 0), room - n
    return first, pieces


def spans(first: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest cell of each slot: the cells of a slot lie next to each other."""
    n = int((first + pieces).max())
    low, high = np.full(n, len(first), np.int64), np.full(n, -1, np.int64)
    for cell, (slot, parts) in enumerate(zip(first.tolist(), pieces.tolist(), strict=True)):
        low[slot : slot + parts] = np.minimum(low[slot : slot + parts], cell)
        high[slot : slot + parts] = cell
    return low, high


def visits_of(met: np.ndarray, first: np.ndarray, pieces: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(slot, bitmap of its cells) of sorted cells."""
    single = met[pieces[met] == 1]
    slots, starts = np.unique(first[single], return_index=True)
    for slot, lo, hi in zip(slots.tolist(), starts.tolist(), [*starts[1:].tolist(), len(single)][: len(slots)], strict=True):
        cells = single[lo:hi]
        bits = np.zeros(high[slot] - low[slot] + 1, bool)
        bits[cells - low[slot]] = True
        yield slot, np.packbits(bits).tobytes()
    for cell in met[pieces[met] > 1].tolist():  # all pieces of a large cell, each a slot of its own
        for piece in range(int(pieces[cell])):
            yield int(first[cell]) + piece, b"\x80"


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, share: float = SHARE, sample: int = SAMPLE, most_centroids: int = MOST_CENTROIDS,
    slot: int = SLOT, least_met: int = LEAST_MET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of (vec_id, embedding) for each row of ``queries``."""
    spark = vectors.sparkSession
    with_id = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asking = queries.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    usable = with_id.where("size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)")
    lengths = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not lengths:
        return empty
    size = lengths[0]["size"]
    index = stage(entries(with_id, size, k + 1), "ann-entries")
    total = index.count()
    taken = index.orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").collect()  # bounded by ``sample``
    x = np.array([np.frombuffer(r["vec"]) for r in taken])
    half, n_centroids = size // 2, int(np.clip(2 * np.sqrt(total), 1, most_centroids))
    books = [k_means(part, n_centroids, SEED + i) if part.shape[1] else np.zeros((1, 0)) for i, part in enumerate((x[:, :half], x[:, half:]))]
    width = len(books[1])

    def assign(batches):
        for b in batches:
            v = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, size)
            cell = nearest(v[:, :half], books[0]) * width + nearest(v[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=["key", "vec", "ids", "cell"])

    placed = stage(index.mapInArrow(assign, "key binary, vec binary, ids array<long>, cell int"), "ann-placed")
    counts = np.zeros(len(books[0]) * width, np.int64)
    for r in placed.groupBy("cell").count().collect():  # at most centroids squared
        counts[r["cell"]] = r["count"]
    first, pieces = lay_out(counts, slot)
    low, high = spans(first, pieces)
    enough = max(k + 1, least_met, int(np.ceil(share * total)))

    def key_queries(batches):
        for b in batches:
            at, v = _vectors(b.column(1), size)
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(_keys(v), pa.binary()), pa.array([r.tobytes() for r in v],
                pa.binary())], names=["query_id", "key", "vec"])

    asked = stage(asking.mapInArrow(key_queries, "query_id long, key binary, vec binary"), "ann-queries")
    distinct = asked.groupBy("key").agg(F.min("vec").alias("vec"))
    n_asked = max(1, asked.count())
    n_blocks = -(-n_asked // QUERY_BLOCK)
    block = F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int")

    def traverse(batches):
        plain = counts.tolist()
        for b in slices(batches, 64):
            rows = []
            for key, vec, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                q = np.frombuffer(vec)
                met = np.sort(np.array(walk(books[0] @ q[:half], books[1] @ q[half:], plain, enough), np.int64))
                rows += [(s, own, key, vec, cells) for s, cells in visits_of(met, first, pieces, low, high)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(),
                    pa.binary(), pa.binary()), strict=True)], names=["slot", "block", "query", "vec", "cells"])

    def lay(batches):
        for b in slices(batches, 4096):
            cell = b.column("cell").to_numpy()
            piece = np.array([int.from_bytes(x[:8], "little") for x in b.column("key").to_pylist()], np.uint64) % pieces[cell].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((first[cell] + piece.astype(np.int64)).astype(np.int32)), *(b.column(c) for c in ("cell", "vec",
                "ids"))], names=["slot", "cell", "vec", "ids"])

    tasks = -(-n_asked // 256)  # walking the heap is the costly part: spread it whatever the size in bytes
    visits = distinct.select("key", "vec", block.alias("block")).repartition(tasks, "key").mapInArrow(traverse,
        "slot int, block int, query binary, vec binary, cells binary")
    laid = placed.select("key", "cell", "vec", "ids").mapInArrow(lay, "slot int, cell int, vec binary, ids array<long>").withColumn("block",
        F.explode(F.expr(f"sequence(0, {n_blocks - 1})")))

    def rerank(queries_in, entries_in):
        """Each query's k + 1 best rows of the slot: entries whose cells it met, by their exact products."""
        out = []
        if queries_in.num_rows and entries_in.num_rows:
            e = np.frombuffer(b"".join(entries_in.column("vec").to_pylist())).reshape(-1, size)
            at, ids = entries_in.column("cell").to_numpy() - low[entries_in.column("slot")[0].as_py()], entries_in.column("ids").to_pylist()
            least = np.array([i[0] for i in ids])
            q = np.frombuffer(b"".join(queries_in.column("vec").to_pylist())).reshape(-1, size)
            own = queries_in.column("query").to_pylist()
            for lo in range(0, len(q), 256):
                rough = q[lo : lo + 256] @ e.T
                for i, cells in enumerate(queries_in.column("cells")[lo : lo + 256].to_pylist()):
                    met = np.flatnonzero(np.unpackbits(np.frombuffer(cells, np.uint8))[at])
                    s = rough[i, met]
                    if len(met) > k + 1:  # all that could be among the k + 1 best, whatever the rounding
                        met = met[s >= np.partition(s, -k - 1)[-k - 1] - 1e-9 * (1 + np.abs(s).max())]
                    exact = (e[met] * q[lo + i]).sum(1)
                    best = [(-float(exact[j]), v) for j in np.lexsort((least[met], -exact))[: k + 1] for v in ids[met[j]]]
                    out += [(own[lo + i], far, v) for far, v in sorted(best)[: k + 1]]
        names, types = ["query", "far", "vec_id"], [pa.binary(), pa.float64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    found = visits.groupBy("slot", "block").cogroup(laid.groupBy("slot", "block")).applyInArrow(rerank, "query binary, far double, vec_id long")
    nth = F.row_number().over(W.partitionBy("query").orderBy("far", "vec_id"))
    lists = found.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("far",
        "vec_id"))).alias("nearest"))
    mine = asked.select("query_id", F.col("key").alias("query")).join(stage(lists, "ann-lists"), "query")
    best = F.slice(F.filter("nearest", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = mine.select("query_id", F.posexplode(best).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
