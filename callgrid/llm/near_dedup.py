"""MinHash near-dedup with an LSH forest.

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with equal sets form a class, and each
class is one node. Each tree of the forest orders the nodes by minhashes of its own. Nodes that share the ``LEAST``
leading hashes of a tree form a region. The depth that is looked at then follows the region's size:

* A region of at most ``NEAR`` + 1 nodes stays in one task, where all its nodes meet.
* A larger one is sorted by all hashes of the signature, from the tree's own on. Each node meets the ``NEAR`` before it,
  its neighbours of longest common prefix, and these agree the deeper the denser the region is; and it meets the most
  central nodes. Of these pairs the task emits a maximum spanning forest. That is only a head start: it joins most of the
  region cheaply. At the end every pair of a larger region that still lies between two components meets, in blocks.

Pairs whose whole signatures agree enough are confirmed on full sets: first the best pair of each node, then the best ones
left between components, then all that are left between two components, then those of the blocks. So of all pairs that
share a region and agree, none is left out, whatever the region's size.

No group is gathered: hot classes collapse by partial aggregation, hot regions are cut by the range partitioning and then
into blocks, and links become components by label joins. A block holds two parts of at least ``PART`` nodes, and a node
goes into at most about ``PARTS`` blocks of a region; in regions where that is too few, the parts grow instead.

Defined results: null text is empty text; without words a document has no shingles and is its own component. With fewer
than five words the whole sequence is one shingle. Rows count by their text: rows that share a doc_id may lie in different
components, and a row without doc_id takes part like any other. component_id is the smallest doc_id of the component, null
if none of it has one; kept where doc_id is that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.llm.components import connected_components, merged_components
from callgrid.llm.text import LOWER, UPPER, WORD, WordHashes
from callgrid.runtime import by_value, slices, stage

by_value(__name__)

WORDS, NUM, DEN = 5, 75, 100
TREES, DEPTH, LEAST, NEAR, CENTRES = 24, 6, 3, 16, 3
#: Bits of the candidate bitmap: 8 MB, whatever the input.
BITS = 1 << 26
#: A pair is confirmed from this agreement of signatures on, four standard deviations below 0.75.
MAYBE = 0.6
#: Nodes of the parts of a large region that meet, and the number of parts above which parts grow instead.
PART, PARTS = 500, 64


class Shingler:
    """Sets of shingle hashes."""

    def __init__(self):
        import xxhash

        self.hash, self.digest, self.words = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest, WordHashes().of
        self.turns = np.random.Generator(np.random.PCG64(9)).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def shingles(self, text: bytes) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        if len(w) < WORDS:
            return np.array([self.hash(w.tobytes() + b"short")], np.uint64)
        n = len(w) - WORDS + 1
        with np.errstate(over="ignore"):
            h = w[:n] * self.turns[0]
            for i in range(1, WORDS):
                h += w[i : i + n] * self.turns[i]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)


def _salts() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(75))
    return tuple(r.integers(0, 2**31, (TREES * DEPTH, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(k) for k in (1, 0))


SALTS = _salts()


def signature(shingles: np.ndarray) -> np.ndarray:
    """One 32-bit minhash per tree and depth, by multiply-add on the shingles' upper halves, in blocks that fit the cache."""
    upper, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full((TREES * DEPTH, 1), 2**32 - 1, np.uint32)
    for i in range(0, len(upper), 512):
        own = upper[None, i : i + 512] * SALTS[0]
        own += SALTS[1]
        np.minimum(least, own.min(1, keepdims=True), out=least)
    return least.ravel()


SIGNED = "doc_id long, row_hash long, n_shingles long, set_key binary, sig binary"


def _batch(columns, kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _sign(batches):
    s, names = Shingler(), [x.split()[0] for x in SIGNED.split(", ")]
    for b in slices(batches):
        rows = []
        for doc, row_hash, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            h = s.shingles((text or "").encode())
            rows.append((doc, row_hash, len(h), s.digest(h.tobytes()) if len(h) else None, signature(h).tobytes() if len(h) else None))
        yield _batch(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), names)


def _region(sig: bytes, t: int) -> int:
    """A hash of a tree and its first LEAST minhashes."""
    import xxhash

    at = 4 * t * DEPTH
    return xxhash.xxh3_64_intdigest(sig[at : at + 4 * LEAST], t) - 2**63


def _regions(batches):
    """(region, node) for each tree."""
    for b in slices(batches, 1024):
        nodes, regions = [], []
        for node, sig in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            nodes += [node] * TREES
            regions += [_region(sig, t) for t in range(TREES)]
        yield _batch((regions, nodes), (pa.int64(), pa.int64()), ["region", "node"])


TREE_ROWS = "region long, node long, tree int, order binary, short binary, homes binary"


def _tree_rows(batches):
    """TREE_ROWS of each node and shared region of it. short is the whole signature with a byte a hash; in a larger region,
    order is the tree's own minhashes and then the other trees', and homes the node's larger regions by tree (0: none);
    else both are null."""
    names, kinds = [x.split()[0] for x in TREE_ROWS.split(", ")], (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    for b in slices(batches, 1024):
        out = []
        for node, sig, regions, larger in zip(*(c.to_pylist() for c in b.columns), strict=True):
            wanted, large, sig32 = set(regions), set(larger), np.frombuffer(sig, np.uint32)
            short = (sig32 & np.uint32(255)).astype(np.uint8).tobytes()
            at = [_region(sig, t) for t in range(TREES)]
            homes = np.array([r if r in large else 0 for r in at], np.int64).tobytes()
            for t, region in enumerate(at):
                if region in wanted:
                    end = (t + 1) * DEPTH
                    order = sig32[t * DEPTH : end].astype(">u4").tobytes() + short[end:] + short[: t * DEPTH] if region in large else None
                    out.append((region, node, t, order, short, homes if region in large else None))
        if out:
            yield _batch(zip(*out, strict=True), kinds, names)


def _spanning(pairs: np.ndarray, est: np.ndarray) -> np.ndarray:
    """Which pairs (positions) form a maximum spanning forest."""
    root, keep = {}, np.zeros(len(pairs), bool)

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for k in np.argsort(-est, kind="stable").tolist():
        a, b = find(int(pairs[k, 0])), find(int(pairs[k, 1]))
        if a != b:
            root[a] = b
            keep[k] = True
    return keep


def _centres(short: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The CENTRES rows of a region that agree most with its commonest value of each hash: where the rows are copies of
    one original, the original itself is of that kind."""
    own = short[lo:hi]
    common = np.array([np.bincount(c, minlength=256).argmax() for c in own.T], np.uint8)
    return lo + np.argsort(-(own == common).sum(1), kind="stable")[:CENTRES]


def _stretches(batches, columns: int):
    """(region, node, short signatures) of the nodes of each batch."""
    for b in slices(batches, 4096):
        if b.num_rows:
            yield b.column("region").to_numpy(), b.column("node").to_numpy(), np.frombuffer(b"".join(b.column("short").to_pylist()),
                np.uint8).reshape(b.num_rows, columns)


def _agreeing(node, short, meetings):
    """Pairs (a, b) with a < b, and their estimates, of the meetings (i, j) that agree enough."""
    pairs, ests = [np.empty((0, 2), np.int64)], [np.empty(0)]
    for i, j in meetings:
        for lo in range(0, len(i), 8192):
            x, y = i[lo : lo + 8192], j[lo : lo + 8192]
            e = ((short[x] == short[y]).mean(1) * 256 - 1) / 255
            ok = (e >= MAYBE) & (node[x] != node[y])
            pairs.append(np.sort(np.stack([node[x][ok], node[y][ok]], 1), 1))
            ests.append(e[ok])
    return np.concatenate(pairs), np.concatenate(ests)


PAIR = "a long, b long, est double"


def _pairs(pair, est) -> pa.RecordBatch:
    return _batch((pair[:, 0], pair[:, 1], est), (pa.int64(), pa.int64(), pa.float64()), ["a", "b", "est"])


def _window(region, new: int):
    """Meetings of each row from ``new`` on with up to NEAR rows before it in its region."""
    for o in range(1, NEAR + 1):
        j = np.arange(max(new, o), len(region))
        same = region[j - o] == region[j]
        yield (j - o)[same], j[same]


def _small_regions(batches):
    """All agreeing pairs of regions of at most NEAR + 1 nodes, which come together."""
    carry = None
    for region, node, short in _stretches(batches, TREES * DEPTH):
        new = 0
        if carry is not None:
            new = len(carry[0])
            region, node, short = (np.concatenate(x) for x in zip(carry, (region, node, short), strict=True))
        yield _pairs(*_agreeing(node, short, _window(region, new)))
        carry = tuple(x[-NEAR:] for x in (region, node, short))


def _large_regions(batches):
    """A spanning forest of the agreeing pairs of a sorted stretch: neighbours, and each region's central nodes with all."""
    carry = None
    for region, node, short in _stretches(batches, TREES * DEPTH):
        new = 0
        if carry is not None:
            new = len(carry[0])
            region, node, short = (np.concatenate(x) for x in zip(carry, (region, node, short), strict=True))
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        sizes = np.diff(np.append(starts, len(region)))
        meetings = list(_window(region, new))
        for lo, n in zip(starts[sizes > NEAR].tolist(), sizes[sizes > NEAR].tolist(), strict=True):
            meetings += [(np.full(n, centre), np.arange(lo, lo + n)) for centre in _centres(short, lo, lo + n)]
        pair, est = _agreeing(node, short, meetings)
        keep = _spanning(pair, est)
        yield _pairs(pair[keep], est[keep])
        # the last region's centres travel on in front of the last NEAR rows
        tail = np.arange(max(0, len(region) - NEAR), len(region))
        if sizes[-1] > NEAR:
            tail = np.unique(np.concatenate([_centres(short, int(starts[-1]), len(region)), tail]))
        carry = tuple(x[tail] for x in (region, node, short))


def _sets(batches):
    """(node, shingles) of the texts whose set is the node's own."""
    s = Shingler()
    for b in slices(batches):
        rows = []
        for node, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            h = s.shingles((text or "").encode()).tobytes()
            if s.digest(h) == key:
                rows.append((node, h))
        if rows:
            yield _batch(zip(*rows, strict=True), (pa.int64(), pa.binary()), ["node", "shingles"])


def _confirm(batches):
    for b in slices(batches, 64):
        ok = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def row_hash(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_hash, n_shingles, component, component_id, kept) for every row of ``docs``.

    component is a number that the rows of a group share, null without shingles; row_hash is that of id and text.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_hash(doc_id, text).alias("row_hash"), F.col(text).alias("text"))
    signed = stage(plain.mapInArrow(_sign, SIGNED), "near-signed")
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("row_hash").alias("row_hash"),
        F.min("sig").alias("sig"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")  # fixed by the staging
    rows = stage(tree_rows(classes, shared_regions(classes)), "near-rows")
    pairs = stage(candidate_pairs(rows), "near-pairs")
    labels = confirmed_components(plain, classes, rows, pairs)
    named = classes.select("set_key", "node", "rep").join(labels, "node", "left")
    least = named.where("label IS NOT NULL").groupBy("label").agg(F.min("rep").alias("least"))
    of_class = named.join(least, "label", "left").select("set_key", F.coalesce("label", "node").alias("component"), F.when(F.col("label").isNull(),
        F.col("rep")).otherwise(F.col("least")).alias("of_class"))
    out = signed.select("doc_id", "row_hash", "n_shingles", "set_key").join(stage(of_class, "near-components"), "set_key", "left")
    component_id = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("of_class"))
    return out.select("doc_id", "row_hash", "n_shingles", "component", component_id.alias("component_id"),
        F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def shared_regions(classes: DataFrame) -> DataFrame:
    """(region, node, large) of all regions of more than one node; a large one has more than a window."""
    regions = stage(classes.select("node", "sig").mapInArrow(_regions, "region long, node long"), "near-regions")
    shared = stage(regions.groupBy("region").count().where("count > 1").select("region", (F.col("count") > NEAR + 1).alias("large")), "near-shared")
    return stage(regions.join(shared, "region").select("region", "node", "large"), "near-met")


def tree_rows(classes: DataFrame, met: DataFrame) -> DataFrame:
    """TREE_ROWS: a row for each node and shared region of it."""
    wanted = met.groupBy("node").agg(F.collect_list("region").alias("regions"), F.collect_list(F.when(F.col("large"),
        F.col("region"))).alias("larger"))  # at most TREES each
    return classes.select("node", "sig").join(wanted, "node").select("node", "sig", "regions", "larger").mapInArrow(_tree_rows, TREE_ROWS)


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, est), a < b, of the nodes that meet in the trees."""
    large = rows.where("homes IS NOT NULL").select("tree", "order", "region", "node", "short")
    small = rows.where("homes IS NULL").select("region", "node", "short")
    key = ["tree", "order", "node"]
    found = large.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_large_regions, PAIR)
    found = found.unionAll(small.repartition("region").sortWithinPartitions("region", "node").mapInArrow(_small_regions, PAIR))
    return found.groupBy("a", "b").agg(F.max("est").alias("est"))


def _meetings(block: pa.Table):
    """(i, others): rows of the two parts of a block that lie in two components and agree enough. A pair meets only in the
    first of the large regions that it shares."""
    region, p, q = (block.column(c)[0].as_py() for c in ("region", "p", "q"))
    side, label = block.column("side").to_numpy(), block.column("label").to_numpy()
    short = np.frombuffer(b"".join(block.column("short").to_pylist()), np.uint8).reshape(block.num_rows, -1)
    homes = np.frombuffer(b"".join(block.column("homes").to_pylist()), np.int64).reshape(block.num_rows, -1)
    few, many = sorted((np.flatnonzero(side == 0), np.flatnonzero(side == 1)), key=len)
    if p == q:
        few = many
    its, of = short[many], label[many]
    for n, i in enumerate(few.tolist()):
        start = n + 1 if p == q else 0
        e = ((its[start:] == short[i]).mean(1) * 256 - 1) / 255
        others = many[start:][(e >= MAYBE) & (of[start:] != label[i])]
        both = (homes[others] == homes[i]) & (homes[i] != 0)
        others = others[homes[i][both.argmax(1)] == region]
        if len(others):
            yield i, others


def _active(block: pa.Table) -> pa.Table:
    """The rows of a block that meet any other."""
    seen = np.zeros(block.num_rows, bool)
    for i, others in _meetings(block):
        seen[i] = seen[others] = True
    return block.filter(pa.array(seen))


def _linked(block: pa.Table) -> pa.Table:
    """Confirmed links of a block, but those between rows that its other links join."""
    label, ids = block.column("label").to_pylist(), block.column("node").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
    root, found = {}, []

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for i, others in _meetings(block):
        for k in others.tolist():
            x, y = find(label[i]), find(label[k])
            m, n = len(sets[i]), len(sets[k])
            if x != y and DEN * min(m, n) >= NUM * max(m, n):
                both = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if DEN * both >= NUM * (m + n - both):
                    root[x] = y
                    found.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
    return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


BLOCK = "region long, p long, q long, side int, node long, label long, short binary, homes binary"


def region_blocks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes of the large regions that hold several components, dealt into blocks of two parts of about PART, or of a share
    of the region where that would be more than PARTS parts.

    The region's largest component makes parts of its own, which meet the other nodes but not each other; every part of
    the others meets every part. A node is repeated for each part it meets. Staged, so that the join can be split at a hot
    region and the blocks of a region go to different tasks.
    """
    large = rows.where("homes IS NOT NULL").select("region", "node", "short", "homes").join(labels.select("node", "label"), "node", "left")
    large = stage(large.select("region", "node", F.coalesce("label", "node").alias("label"), "short", "homes"), "near-large")
    sizes = large.groupBy("region", "label").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("region").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"),
        F.count("*").alias("n_labels")).where("n_labels > 1")
    part = F.greatest(F.lit(PART), F.ceil(F.col("n") / PARTS))
    sizes = sizes.select("region", "main", F.ceil(F.col("n_main") / part).alias("mains"), F.ceil((F.col("n") - F.col("n_main")) / part).alias("others"))
    dealt = large.join(sizes, "region").withColumn("is_main", F.col("label") == F.col("main"))
    k = F.when(F.col("is_main"), F.pmod(F.xxhash64("node"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), "others"))
    dealt = dealt.withColumn("k", k).withColumn("x", F.explode(F.expr("sequence(if(is_main, mains, 0L), mains + others - 1)")))
    side = F.when(F.col("k") > F.col("x"), 1).otherwise(0)
    return stage(dealt.select("region", F.least("k", "x").alias("p"), F.greatest("k", "x").alias("q"), side.alias("side"), "node", "label", "short",
        "homes"), "near-blocks")


def region_links(plain: DataFrame, classes: DataFrame, rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): confirmed links between components, of all pairs that share a large region.

    Blocks meet twice: first by signatures, which leaves the nodes that meet any other, then with the shingles of those.
    Only nodes and links come out, so no table of pairs is made.
    """
    key = ["region", "p", "q"]
    active = stage(region_blocks(rows, labels).groupBy(*key).applyInArrow(_active, BLOCK), "near-active")
    sets = set_table(plain, classes, active.select("node").distinct())
    return stage(active.join(sets, "node").groupBy(*key).applyInArrow(_linked, "a long, b long"), "near-late")


def set_table(plain: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, from one row of each. It is found by its hash, so copies stay where they are, and proved by
    its set."""
    wanted = stage(classes.select("node", "set_key", "row_hash").join(nodes, "node"), "near-wanted")
    texts = maybe_among(plain, wanted).select("row_hash", "text").join(wanted, "row_hash").select("node", "set_key", "text").distinct()
    return stage(texts.mapInArrow(_sets, "node long, shingles binary"), "near-sets")


def maybe_among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose row_hash may be among those of ``wanted``, by a bitmap: of fixed size, so it may be broadcast. It only
    spares the shuffle of other texts, fewer of them the more are wanted; an exact join follows."""
    bit = F.pmod(F.col("row_hash"), F.lit(BITS))
    maps = wanted.groupBy(F.bitmap_bucket_number(bit).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = rows.withColumn("__bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "__bucket")
    return hit.where(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def confirmed_components(plain: DataFrame, classes: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label) of all nodes with a confirmed link."""
    def confirm(chosen: DataFrame, sets: DataFrame) -> DataFrame:
        a_sets, b_sets = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
        whole = chosen.select("a", "b").join(b_sets, "b").join(a_sets, "a").select("a", "b", "of_a", "of_b")
        return stage(whole.mapInArrow(_confirm, "a long, b long, linked boolean"), "near-confirmed")

    sets = set_table(plain, classes, pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct())
    ends = pairs.select("a", "b", "est", F.col("a").alias("v")).unionAll(pairs.select("a", "b", "est", F.col("b").alias("v")))
    best = ends.groupBy("v").agg(F.max(F.struct("est", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    tried = confirm(best, sets)
    labels = connected_components(tried.where("linked").select("a", "b"))

    def between(labels: DataFrame, tried: DataFrame) -> DataFrame:
        """The pairs not tried that join two components, with label and size of each."""
        sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label")
        la, lb = (sized.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
        left = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left")
        return left.select("a", "b", "est", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"), F.coalesce("na", F.lit(1)).alias("na"),
            F.coalesce("nb", F.lit(1)).alias("nb")).where("la <> lb")

    left = between(labels, tried)
    # between two small components every pair goes now; towards a larger one a node's best does, and spares most of the rest,
    # which follows below
    small = left.where("na < 3 AND nb < 3").select("a", "b")
    large = left.where("na > 2 OR nb > 2").groupBy(F.when(F.col("na") > F.col("nb"), F.col("b")).otherwise(F.col("a")), F.greatest("la", "lb"),
        F.least("la", "lb")).agg(F.max(F.struct("est", "a", "b")).alias("x"))
    chosen = stage(small.unionAll(large.select("x.a", "x.b")).distinct(), "near-left")
    more = confirm(chosen, sets)
    if not more.where("linked").isEmpty():
        labels = merged_components(labels, more.where("linked"))
    rest = stage(between(labels, tried.unionAll(more)).select("a", "b"), "near-rest")
    if not rest.isEmpty():
        last = confirm(rest, sets).where("linked")
        if not last.isEmpty():
            labels = merged_components(labels, last)
    found = region_links(plain, classes, rows, labels)
    return labels if found.isEmpty() else merged_components(labels, found)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' '))) END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS k
  FROM items p JOIN items q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM common WHERE {DEN} * k >= {NUM} * (na + nb - k)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(v, r) AS (SELECT DISTINCT a, a FROM edges UNION SELECT reach.v, edges.b FROM reach JOIN edges ON reach.r = edges.a
), least AS (SELECT v, min(r) AS component FROM reach GROUP BY v)
SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least ON v = doc_id
"""
