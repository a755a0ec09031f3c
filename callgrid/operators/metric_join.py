"""Rows within a distance of each other, by pivots and the triangle inequality, and density clusters on top of it.

Rows are placed in the cell of their nearest pivot, a cell is cut into rings about its pivot, and a ring into blocks of
bounded size. A row visits a block only if, seen from every pivot, it is no farther than ``eps`` from the cell, and from
the block's own pivot no farther from the ring: by the triangle inequality no other block can hold a neighbour, so the join
is exact in any number of dimensions, and what it skips grows with the structure of the data.

Equal vectors are one node with a weight, so a vector that many rows hold costs one row. Blocks that follow each other form
groups of bounded size, and two groups meet in one task, once for both. A row is sent to a pair of groups once, whatever
blocks it visits there, packed with others, in single precision where that loses nothing. Groups grow with the table up to
their bound, so the copies of a row do not; beyond it the pairs are met in rounds, each of which drops its shuffle before
the next. What leaves a task is a number or a few links a row, never the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.runtime import by_value, remove, slices, stage, staged_path, steady_memory, trimmed

by_value(__name__)

#: Rows of a block, rows of a group, and pivots, of which the driver holds the squared number of bounds.
BLOCK, VISITORS, PIVOTS = 4096, 65536, 64
#: Rows of a group at least, where a table has more; groups of a smaller table; numbers of a group; copies of a row in a round;
#: partitions of a round.
LEAST, GROUPS, NUMBERS, COPIES, TASKS = 1024, 12, 1 << 23, 24, 512


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, one row of ``y`` after the other."""
    return np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in y], 1) if len(y) else np.zeros((len(x), 0))


def within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` are no farther than ``eps``: by products, and near the limit by differences. One matrix
    of numbers is held, and changed in place."""
    a, b, limit = (x * x).sum(1), (y * y).sum(1), eps * eps
    rough = (-2 * x) @ y.T
    rough += a[:, None]
    rough += b
    out = rough <= limit
    rough -= limit
    np.abs(rough, out=rough)
    close = np.argwhere(rough <= 1e-9 * (1 + limit + a.max(initial=0) + b.max(initial=0)))
    for lo in range(0, len(close), 8192):  # copies are many
        i, j = close[lo : lo + 8192].T
        out[i, j] = np.sqrt(((x[i] - y[j]) ** 2).sum(1)) <= eps
    return out


def bounded(x: np.ndarray, y: np.ndarray, eps: float):
    """A function of rows of ``x`` and rows of ``y`` (indexes) that yields the pairs (i, j) no farther than ``eps``, some at a
    time. Pairs get a lower bound by products in single precision, and those that it leaves are measured by differences, or by
    ``within`` where they are many."""
    middle = y.mean(0)
    u, v = x - middle, y - middle
    size = max(np.abs(u).max(initial=0), np.abs(v).max(initial=0)) or 1.0
    u, v = u / size, v / size
    a, b = (u * u).sum(1), (v * v).sum(1)
    slack = 2.0**-22 * (x.shape[1] + 16) * (float(a.max(initial=0)) + float(b.max(initial=0)))
    top = np.nextafter(((eps * (1 + 1e-9) / size) ** 2 + slack - a).astype(np.float32), np.float32(np.inf))
    left, right = np.column_stack([-2 * u, np.ones(len(u))]).astype(np.float32), np.column_stack([v, b]).astype(np.float32)

    most = min(256, len(x)) * min(4096, len(y))
    held, below = np.empty(most, np.float32), np.empty(most, bool)  # once: fresh pages for each tile cost more than its products

    def near(rows: np.ndarray, columns: np.ndarray):
        for start in range(0, len(columns), 4096):
            j = columns[start : start + 4096]
            other = np.ascontiguousarray(right[j].T)
            for lo in range(0, len(rows), 256):
                i = rows[lo : lo + 256]
                tile, mask = (t[: len(i) * len(j)].reshape(len(i), len(j)) for t in (held, below))
                at = np.flatnonzero(np.less_equal(np.matmul(left[i], other, out=tile), top[i, None], out=mask))
                if len(at) > len(i) * len(j) // 32:
                    r, c = np.nonzero(within(x[i], y[j], eps))
                    yield i[r], j[c]
                elif len(at):
                    r, c = i[at // len(j)], j[at % len(j)]
                    good = np.concatenate([np.sqrt(((x[r[k : k + 8192]] - y[c[k : k + 8192]]) ** 2).sum(1)) <= eps for k in range(0, len(at), 8192)])
                    yield r[good], c[good]

    return near


@dataclass
class Rows:
    """Rows of a group in a task, in the order of their blocks. ``visits``: the other group's blocks, a column for each."""

    id: np.ndarray
    weight: np.ndarray
    block: np.ndarray
    core: np.ndarray
    label: np.ndarray
    visits: np.ndarray
    v: np.ndarray

    def blocks(self):
        """(block, its rows)."""
        found, start = np.unique(self.block, return_index=True)
        return zip(found.tolist(), np.split(np.arange(len(self.block)), start[1:]), strict=True) if len(found) else ()


#: What a row has in a packed chunk besides its visits and its vector.
FIELDS = (("id", np.int64), ("weight", np.int64), ("block", np.int32), ("core", np.bool_), ("label", np.int64))


@dataclass
class Layout:
    """Distinct vectors in blocks, and the visits that can find a neighbour: what all passes over a join read."""

    points: DataFrame  # id, v, weight, block
    visits: DataFrame  # id, block
    group: np.ndarray  # of each block
    visited: object  # of a matrix of vectors: which blocks each row visits
    axes: int
    rows: int

    def meet(self, points: DataFrame, make, schema: str, label: str, diagonal: bool = False) -> DataFrame:
        """``make(p rows, q rows, first blocks of p and q)`` for every pair of groups that visit each other; q rows are None where
        a group meets itself, and with ``diagonal`` no others meet. ``points`` may have a label, which marks cores."""
        group, visited, axes = self.group, self.visited, self.axes
        n = int(group[-1]) + 1
        first = np.searchsorted(group, np.arange(n + 1))
        rounds = 1 if diagonal else -(-n // COPIES)
        has = "label" in points.columns
        points = points.select("id", "weight", "block", "v", (F.col("label") if has else F.lit(None)).cast("long").alias("label"))

        def spread(this):
            def pack(batches):
                for b in slices(batches, 2048):
                    v, block = _matrix(b.column("v")), b.column("block").to_numpy()
                    label = b.column("label")
                    columns = dict(id=b.column("id").to_numpy(), weight=b.column("weight").to_numpy(), block=block,
                                   core=label.is_valid().to_numpy(zero_copy_only=False), label=label.fill_null(0).to_numpy())
                    seen, own, out = visited(v), group[block], []
                    for h in np.unique(own).tolist():
                        rows = np.flatnonzero(own == h)
                        for g in [h] if diagonal else [g for g in range(n) if (h + g) % rounds == this]:
                            there = seen[rows, first[g] : first[g + 1]]
                            at = there.any(1)
                            if at.any():
                                who, there = rows[at], there[at]
                                with np.errstate(over="ignore"):
                                    small = v[who].astype(np.float32)
                                x = small if (small == v[who]).all() else v[who]
                                out.append((min(h, g), max(h, g), h > g, len(who), *(columns[k][who].astype(t).tobytes() for k, t in FIELDS),
                                            np.packbits(there, axis=1).tobytes(), x.tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

            return pack

        names = ["p", "q", "behind", "n", *(k for k, _ in FIELDS), "visits", "v"]
        kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), *[pa.binary()] * (len(FIELDS) + 2)]
        packed = "p int, q int, behind boolean, n int, " + ", ".join(f"{k} binary" for k in names[4:])

        def unpacked(t, blocks: int) -> Rows:
            n_of = t.column("n").to_pylist()
            held = lambda k, of: np.concatenate([of(x.as_py(), n) for x, n in zip(t.column(k), n_of, strict=True)])
            bits = lambda x, n: np.unpackbits(np.frombuffer(x, np.uint8).reshape(n, -1), axis=1, count=blocks).astype(bool)
            wide = lambda x, n: np.frombuffer(x, np.float32 if len(x) == 4 * n * axes else np.float64).reshape(n, axes).astype(np.float64)
            columns = [held(k, lambda x, _, kind=kind: np.frombuffer(x, kind)) for k, kind in FIELDS] + [held("visits", bits), held("v", wide)]
            order = np.lexsort((columns[0], columns[2]))
            return Rows(*(c[order] for c in columns))

        def pair(t):
            steady_memory(8 << 20)
            p, q = t.column("p")[0].as_py(), t.column("q")[0].as_py()
            behind = t.column("behind")
            blocks = lambda g: int(first[g + 1] - first[g])
            sides = [unpacked(t.filter(side), blocks(g)) if side.true_count else None for side, g in ((_not(behind), q), (_flat(behind), p))]
            found = make(sides[0], sides[1], int(first[p]), int(first[q])) if sides[0] and (sides[1] or p == q) else None
            out = empty if found is None else found
            if t.nbytes > 1 << 20:
                del sides
                trimmed()
            return out

        empty = pa.Table.from_batches([], _schema(schema))
        every = None
        for this in range(rounds):
            sent = points.mapInArrow(spread(this), packed)
            pairs = n if diagonal else -(-n * (n + 1) // 2 // rounds)
            tasks = min(4 * pairs, TASKS, 1 + self.rows * min(n, COPIES) // LEAST)  # by hash: with fewer, many would hold two pairs
            met = sent.repartition(tasks, "p", "q").groupBy("p", "q").applyInArrow(pair, schema)
            met = met if rounds == 1 else stage(met, label)
            every = met if every is None else every.unionAll(met)
        return every


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _not(column) -> pa.Array:
    import pyarrow.compute as pc

    return _flat(pc.invert(column))


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(k, kinds[t]) for k, t in (x.split() for x in text.split(", "))])


def meetings(p: Rows, q: Rows | None, first_p: int, first_q: int, eps: float, rows=None, columns=None, once: bool = False, apart=None):
    """(i, j, one): pairs of rows no farther than ``eps``, of two groups or, without ``q``, of one. ``rows``, ``columns``: which of
    them take part. ``once``: two blocks of one group meet once, and only pairs within a block come in both orders (one is
    False). ``apart``: which of the rows x and y still have to meet, as pairs of some of them."""
    other = p if q is None else q
    near = bounded(p.v, other.v, eps)
    for a, i in p.blocks():
        i = i if rows is None else i[rows[i]]
        for b, j in other.blocks() if len(i) else ():
            if once and b < a:
                continue
            x = i[p.visits[i, b - first_q]]
            y = j if columns is None else j[columns[j]]
            y = y[other.visits[y, a - first_p]]
            for part in (((x, y),) if apart is None else apart(x, y)) if len(x) and len(y) else ():
                for found in near(*part):
                    yield *found, a != b


def layout(nodes: DataFrame, eps: float, block: int = BLOCK, pivots: int = PIVOTS, visitors: int = VISITORS) -> Layout | None:
    """The layout of staged nodes (id, v, weight); None without nodes."""
    n = nodes.count()
    if not n:
        return None
    count = min(pivots, 1 + n // max(1, block // 16))
    chosen = nodes.orderBy(F.xxhash64("id"), "id").limit(count).select("v").collect()  # ``pivots`` rows at most
    centres = np.array([r["v"] for r in chosen], float).reshape(len(chosen), -1)
    slack = eps + 1e-9 * (1 + eps + float(np.abs(centres).max(initial=0)))

    def place(batches):
        for b in slices(batches, 1024):
            d = _far(_matrix(b.column("v")), centres)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                             names=[*b.schema.names, "cell", "d"])

    def extents(batches):
        low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
        for b in slices(batches, 1024):
            d, cell = _far(_matrix(b.column("v")), centres), b.column("cell").to_numpy()
            np.minimum.at(low, cell, d)
            np.maximum.at(high, cell, d)
        at = np.flatnonzero(np.isfinite(low).all(1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, count).astype(np.int32)), pa.array(np.tile(np.arange(count, dtype=np.int32), len(at))),
                                          pa.array(low[at].ravel()), pa.array(high[at].ravel())], names=["cell", "pivot", "low", "high"])

    kinds = "id long, v array<double>, weight long, cell int, d double"
    paths = [staged_path(nodes.sparkSession, k) for k in ("metric-placed", "metric-rings")]
    placed = stage(nodes.select("id", "v", "weight").mapInArrow(place, kinds), "metric-placed", paths[0])
    low, high = np.full((count, count), np.inf), np.full((count, count), -np.inf)
    found = placed.mapInArrow(extents, "cell int, pivot int, low double, high double").groupBy("cell", "pivot")
    for r in found.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # pivots squared
        low[r["cell"], r["pivot"]], high[r["cell"], r["pivot"]] = r["low"], r["high"]
    # Rings: a cut for every ``block`` rows of a cell, by a sketch; rows on equal distances are cut by a hash below.
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    grid = int(min(10_000, max(1, -(-max(sizes.values()) // block))))
    cuts = placed.groupBy("cell").agg(F.percentile_approx("d", F.array(*[F.lit(i / grid) for i in range(1, grid + 1)]), F.lit(10 * grid)).alias("c"))
    ends = {r["cell"]: np.unique(np.array(r["c"])[:: max(1, grid * block // max(1, sizes[r["cell"]]))]) for r in cuts.collect()}
    empty = np.zeros(0)

    def ring(batches):
        for b in slices(batches, 4096):
            cell, d = b.column("cell").to_numpy(), b.column("d").to_numpy()
            at = np.array([np.searchsorted(ends.get(c, empty), x) for c, x in zip(cell.tolist(), d.tolist(), strict=True)], np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "ring"])

    ringed = stage(placed.mapInArrow(ring, kinds + ", ring int"), "metric-rings", paths[1])
    about = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    rings = sorted(tuple(r) for r in about.collect())  # a row for each block of rows
    first, parts, total = {}, {}, 0
    for c, r, rows, *_ in rings:
        first[c, r], parts[c, r] = total, -(-rows // block)
        total += parts[c, r]

    def lay(batches):
        import xxhash

        for b in slices(batches, 4096):
            keys = list(zip(b.column("cell").to_pylist(), b.column("ring").to_pylist(), strict=True))
            hashes = [xxhash.xxh3_64_intdigest(i.to_bytes(8, "little", signed=True)) for i in b.column("id").to_pylist()]
            at = [first[k] + h % parts[k] for k, h in zip(keys, hashes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("weight"), pa.array(at, pa.int32())], names=["id", "v", "weight", "block"])

    near, far, cell_of, rows_of = (np.array(c) for c in zip(*[(near, far, c, rows / parts[c, r]) for c, r, rows, near, far in rings for _ in range(parts[c, r])],
        strict=True))
    # Groups: blocks in their order, cut by rows.
    cores = nodes.sparkSession.sparkContext.defaultParallelism
    most = min(visitors, max(1, NUMBERS // max(1, centres.shape[1])))
    size = min(most, max(LEAST, -(-n // max(GROUPS, int((8 * cores) ** 0.5)))))
    group = np.unique(np.floor((np.cumsum(rows_of) - rows_of / 2) / size), return_inverse=True)[1]

    def visited(v):
        """Which blocks each row of a matrix visits."""
        out = np.empty((len(v), total), bool)
        for lo in range(0, len(v), 256):
            d = _far(v[lo : lo + 256], centres)
            cells = np.ones((len(d), count), bool)
            for i in range(count):
                cells &= (d[:, i, None] >= low[:, i] - slack) & (d[:, i, None] <= high[:, i] + slack)
            own = d[:, cell_of]
            out[lo : lo + 256] = cells[:, cell_of] & (own >= near - slack) & (own <= far + slack)
        return out

    def visit(batches):
        for b in slices(batches, 1024):
            row, block = np.nonzero(visited(_matrix(b.column("v"))))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(block.astype(np.int32))], names=["id", "block"])

    points = stage(ringed.mapInArrow(lay, "id long, v array<double>, weight long, block int"), "metric-points")
    for path in paths:
        remove(nodes.sparkSession, path)
    return Layout(points, points.select("id", "v").mapInArrow(visit, "id long, block int"), group, visited, centres.shape[1], n)


def weights_near(own: Layout, eps: float) -> DataFrame:
    """(id, n): the weight of all nodes within ``eps`` of a node, its own included."""

    def count(p, q, *first):
        other = p if q is None else q
        n = np.zeros(len(p.id), np.int64)
        m = n if q is None else np.zeros(len(q.id), np.int64)
        for i, j, one in meetings(p, q, *first, eps, once=q is None):
            np.add.at(n, i, other.weight[j])
            if one:
                np.add.at(m, j, p.weight[i])
        ids, n = (p.id, n) if q is None else (np.concatenate([p.id, q.id]), np.concatenate([n, m]))
        return pa.table([pa.array(ids[n > 0]), pa.array(n[n > 0])], names=["id", "n"])

    return own.meet(own.points, count, "id long, n long", "metric-weights").groupBy("id").agg(F.sum("n").alias("n"))


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of ``i`` and ``j``, pair by pair, in place. ``root``: of each member, the smallest one of its tree."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def parts(own: Layout, cores: DataFrame, eps: float) -> DataFrame:
    """(id, label): the connected parts of each group's cores, a part named by its smallest id."""

    def join(p, _, *first):
        root = np.arange(len(p.id))
        for i, j, _ in meetings(p, None, *first, eps, once=True):
            unite(root, i, j)
        least = np.full(len(p.id), np.iinfo(np.int64).max)
        np.minimum.at(least, root, p.id)
        return pa.table([pa.array(p.id), pa.array(least[root])], names=["id", "label"])

    return own.meet(own.points.join(cores, "id", "left_semi"), join, "id long, label long", "metric-parts", diagonal=True)


def links(own: Layout, labelled: DataFrame, eps: float) -> DataFrame:
    """(a, b, core): parts that touch each other across groups, no more for two groups than join them; and the parts b that a
    row a touches which is no core itself. A row that is no core has few neighbours. ``labelled``: the cores' parts."""

    def link(p, q, *first):
        other = p if q is None else q
        out = [np.zeros((0, 2), np.int64)]
        names, at = np.unique(np.concatenate([p.label[p.core], other.label[other.core]]), return_inverse=True)
        root, of_p, of_q = np.arange(len(names)), np.zeros(len(p.id), np.int64), np.zeros(len(other.id), np.int64)
        of_p[p.core], of_q[other.core] = at[: p.core.sum()], at[p.core.sum() :]

        def apart(x, y):
            """All but pairs of the largest part, where both sides have it."""
            a, b = root[of_p[x]], root[of_q[y]]
            at, there = a == np.bincount(a).argmax(), b == np.bincount(a).argmax()
            return [(x, y)] if not there.any() else [(x[~at], y), (x[at], y[~there])]

        if len(names):
            for i, j, _ in meetings(p, q, *first, eps, rows=~p.core, columns=other.core):
                out.append(np.unique(np.stack([p.id[i], other.label[j]], 1), axis=0))
            if q is not None:
                for i, j, _ in meetings(p, q, *first, eps, rows=p.core, columns=~q.core):
                    out.append(np.unique(np.stack([q.id[j], p.label[i]], 1), axis=0))
                for i, j, _ in meetings(p, q, *first, eps, rows=p.core, columns=q.core, apart=apart):
                    unite(root, of_p[i], of_q[j])
        border, joined = np.concatenate(out), np.flatnonzero(root != np.arange(len(root)))
        a, b = np.concatenate([border[:, 0], names[joined]]), np.concatenate([border[:, 1], names[root[joined]]])
        return pa.table([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= len(border))], names=["a", "b", "core"])

    points = own.points.join(labelled.select("id", "label"), "id", "left")
    return own.meet(points, link, "a long, b long, core boolean", "metric-links")


def distinct_vectors(rows: DataFrame, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """(rows (id, v) that can be measured, nodes (id, v, weight) of their distinct vectors), both staged. A vector with
    null or non-finite components, an empty or a null one can't."""
    v = F.transform(F.col(features).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 equals 0.0
    sound = F.col(features).isNotNull() & (F.size(features) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = stage(rows.where(sound & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), v.alias("v")), "metric-rows")
    return own, stage(own.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")).select("id", "v", "weight"), "metric-nodes")
