"""Clustering and its measures. Density clustering joins blocks about pivots, never all pairs; measures come from one contingency."""

from __future__ import annotations

from math import lgamma

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.runtime import by_value

by_value(__name__)


def k_means(rows: DataFrame, k: int, seeds: int = 5, features: str = "features") -> DataFrame:
    """(id, label, cluster): the best of several seeded runs."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = rows.withColumn("__v", array_to_vector(features))
    x = x.cache()  # every run passes over the rows many times
    models = [KMeans(k=k, seed=s, featuresCol="__v", predictionCol="cluster").fit(x) for s in range(seeds)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(x).select("id", "label", "cluster")


def dbscan(rows: DataFrame, eps: float, least: int, axes: int | None = None, features: str = "features", **layout) -> DataFrame:
    """(id, cluster): density clusters by Euclidean distance, null for noise; a border point joins its smallest neighbouring
    cluster, which is named by its smallest core id. ``layout``: sizes as for ``metric_join.layout``.

    Groups of rows meet in pairs, twice: first to count, then to link. A group's cores are united within it first, and two
    groups leave no more links than join their parts, so a dense region leaves few rows, not its pairs. Equal vectors have
    equal fates. A vector that can't be measured is noise. Vectors are of one length. ``axes`` stays for callers that name it:
    whole vectors are compared, and blocks need no choice of coordinates."""
    from callgrid.operators import metric_join as M
    from callgrid.runtime import stage

    own, nodes = M.distinct_vectors(rows, features)
    laid = M.layout(nodes, eps, **layout)
    if laid is None:
        return rows.select("id", F.lit(None).cast("long").alias("cluster"))
    cores = stage(M.weights_near(laid, eps).where(F.col("n") >= least).select("id"), "dbscan-cores")
    parts = stage(M.parts(laid, cores, eps), "dbscan-parts")
    links = stage(M.links(laid, parts, eps), "dbscan-links")
    named = parts.select(F.col("label").alias("a"), F.col("label").alias("b")).distinct()
    labels = stage(components(links.where("core").select("a", "b").unionAll(named)), "dbscan-labels")
    member = parts.unionAll(links.where("NOT core").select(F.col("a").alias("id"), F.col("b").alias("label")))
    touched = member.join(labels.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label")
    found = touched.groupBy("id").agg(F.min("cluster").alias("cluster"))
    by_vector = stage(nodes.select("id", "v").join(found, "id").select("v", "cluster"), "dbscan-vectors")
    placed = own.join(by_vector, "v").select("id", "cluster")
    return rows.select("id").join(placed.dropDuplicates(["id"]), "id", "left")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over (a, b) links, by label joins staged after each round."""
    from callgrid.runtime import stage

    both = stage(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "component-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = stage(labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "component-labels")
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stage(new.join(jump, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "component-labels")


def bandwidth(x: np.ndarray, share: float = 0.2) -> float:
    """Mean distance of a row to the last of its ``share`` nearest rows, itself included."""
    k = max(1, int(len(x) * share))
    return float(np.mean([np.partition(np.sqrt(((x - v) ** 2).sum(1)), k - 1)[k - 1] for v in x]))


def modes(x: np.ndarray, width: float, rounds: int = 300) -> np.ndarray:
    """Centres of mean shift with a flat kernel, from one seed per occupied bin of that width, densest first; a centre
    within the width of a denser one is dropped."""
    found = {}
    for seed in np.unique(np.round(x / width), axis=0) * width:
        at = seed
        for _ in range(rounds):
            near = ((x - at) ** 2).sum(1) <= width * width
            if not near.any():
                break
            moved = x[near].mean(0)
            done, at = np.sqrt(((moved - at) ** 2).sum()) <= 1e-3 * width, moved
            if done:
                break
        if n := int((((x - at) ** 2).sum(1) <= width * width).sum()):
            found[tuple(at)] = n
    kept: list = []
    for at in sorted(found, key=lambda c: (-found[c], c)):
        if all(((np.array(at) - c) ** 2).sum() > width * width for c in kept):
            kept.append(np.array(at))
    return np.array(kept)


def mean_shift(rows: DataFrame, sample: int = 3500, width: float | None = None, features: str = "features", seed: int = 0) -> DataFrame:
    """(id, label, cluster): all rows by their nearest mode. Modes are found on the ``sample`` rows with the smallest hash, a
    stated bound (500 rows for each of seven classes), the width on at most 1000 of them."""
    chosen = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select(features).collect()
    x = np.array([r[0] for r in chosen], float)
    if not len(x):
        return rows.select("id", "label", F.lit(None).cast("int").alias("cluster"))
    width = width or bandwidth(x[:1000])
    centres = modes(x, width) if width > 0 else np.unique(x, axis=0)
    axes = F.lit([[float(v) for v in c] for c in centres])  # bounded by the sample
    far = F.transform(axes, lambda c: F.aggregate(F.zip_with(features, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    return rows.select("id", "label", (F.array_position(far, F.array_min(far)) - 1).cast("int").alias("cluster"))


def distance_sums(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, tile: tuple[int, int] = (256, 512)) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distances of the rows of ``x`` and ``y``, summed for each row of ``x`` by the columns of ``of_y`` (rows of
    ``y`` by clusters, 0 or 1), and the other way round. By products in double precision about the common middle; pairs
    much nearer than they are far from it are measured by differences."""
    middle = (x.mean(0) + y.mean(0)) / 2
    x, y = x - middle, y - middle
    a, b = (x * x).sum(1), (y * y).sum(1)
    left, right = np.column_stack([-2 * x, np.ones(len(x))]), np.ascontiguousarray(np.column_stack([y, b]).T)
    rows, columns = np.zeros((len(x), of_y.shape[1])), np.zeros((len(y), of_x.shape[1]))
    for lo in range(0, len(x), tile[0]):
        i = slice(lo, lo + tile[0])
        for start in range(0, len(y), tile[1]):
            j = slice(start, start + tile[1])
            d = left[i] @ right[:, j]
            d += a[i, None]
            limit = 1e-4 * (a[i, None] + float(b[j].max()))
            close = np.argwhere(d <= limit) if d.min() <= limit.max() else ()
            np.sqrt(np.maximum(d, 0, out=d), out=d)
            for at in range(0, len(close), 8192):  # copies are many
                p, r = close[at : at + 8192].T
                d[p, r] = np.sqrt(((x[lo + p] - y[start + r]) ** 2).sum(1))
            rows[i] += d @ of_y[j]
            columns[j] += d.T @ of_x[i]
    return rows, columns


def silhouette(rows: DataFrame, features: str = "features", block: int = 32768) -> DataFrame:
    """(id, cluster, silhouette) of the assigned rows: how much nearer the own cluster is than the next one, 0 for a cluster
    of one row. Exact, in blocks: a task holds two blocks, which meet once for both, and returns a sum of distances per row
    and cluster. Blocks grow with the table, work with its square."""
    import pyarrow as pa

    from callgrid.operators.knn import LEAST, _matrix
    from callgrid.runtime import stage

    own = stage(rows.where("cluster IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("cluster").cast("long").alias("cluster"),
        F.col(features).alias("v")), "silhouette-rows")
    size = max(1, own.count())
    n = -(-size // min(block, max(LEAST, -(-size // 16))))
    part = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    # Each pair of blocks once, the smaller number first: a block is left of those behind it and right of those before.
    a = own.withColumn("p", part).select("p", F.explode(F.sequence("p", F.lit(n - 1))).alias("q"), "id", "cluster", "v")
    b = own.withColumn("q", part).select(F.explode(F.sequence(F.lit(0), "q")).alias("p"), "q", "id", "cluster", "v")
    a, b = (t.repartition(n * (n + 1), "p", "q") for t in (a, b))

    def sums(x, y):
        out = [[], [], [], []]
        if x.num_rows and y.num_rows:
            sides = []
            for t in (x, y):
                clusters, of = np.unique(t.column("cluster").to_numpy(), return_inverse=True)
                sides.append((t.column("id").to_numpy(), clusters, np.bincount(of), of, _matrix(t.column("v"))))
            (ids, named, counts, of_x, v), (ids2, named2, counts2, of_y, v2) = sides
            same = x.column("p")[0].as_py() == x.column("q")[0].as_py()
            # A column for each of some clusters at a time: their number may be large.
            for lo in range(0, max(len(named), len(named2)), 64):
                one = lambda of, c: (of[:, None] == np.arange(lo, min(lo + 64, len(c)))).astype(float)
                left, right = distance_sums(v, v2, one(of_x, named)[:, : 0 if same else None], one(of_y, named2))
                for who, c, k, total in ((ids, named2[lo : lo + 64], counts2[lo : lo + 64], left), (ids2, named[lo : lo + 64], counts[lo : lo + 64], right)):
                    if total.shape[1]:
                        for column, values in zip(out, (np.repeat(who, len(c)), np.tile(c, len(who)), total.ravel(), np.tile(k, len(who))), strict=True):
                            column.append(values)
        kinds = ((pa.int64(), np.int64), (pa.int64(), np.int64), (pa.float64(), float), (pa.int64(), np.int64))
        return pa.table([pa.array(np.concatenate([np.zeros(0, k), *c]).astype(k), t) for c, (t, k) in zip(out, kinds, strict=True)], names=["id", "other",
            "total", "n"])

    met = a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInArrow(sums, "id long, other long, total double, n long")
    means = met.groupBy("id", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).join(own.select("id", "cluster"), "id")
    inner, same = F.col("total") / (F.col("n") - 1), F.col("other") == F.col("cluster")
    both = means.groupBy("id", "cluster").agg(F.max(F.when(same & (F.col("n") > 1), inner)).alias("a"), F.min(F.when(~same,
        F.col("total") / F.col("n"))).alias("b"))
    value = F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0))
    return both.select("id", "cluster", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(value).alias("silhouette"))


def measures(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row for an assignment (id, cluster) of ``rows`` (id, label, features): contingency measures, adjusted mutual
    information, the mean silhouette of the assigned rows (null with fewer than two clusters), clusters found."""
    table = rows.select("id", "label", "features").join(assigned.select("id", "cluster"), "id")
    counts = table.where("cluster IS NOT NULL").groupBy("cluster", "label").count().collect()  # clusters x labels
    clusters, labels = (sorted({r[i] for r in counts}) for i in (0, 1))
    matrix = np.zeros((len(clusters), len(labels)))
    for r in counts:
        matrix[clusters.index(r[0]), labels.index(r[1])] = r["count"]
    ami = adjusted_mutual_information(matrix) if len(counts) else 0.0
    mean = silhouette(table).agg(F.avg("silhouette")).first()[0] if len(clusters) > 1 else None
    return contingency_measures(table).withColumns({"ami": F.lit(float(ami)), "silhouette": F.lit(mean).cast("double"),
        "clusters_found": F.lit(len(clusters)), "assigned_fraction": 1 - F.col("noise_fraction")})


def explore(rows: DataFrame, n_clusters: int, eps: float = 1.5, least: int = 10, seeds: int = 20) -> dict[str, DataFrame]:
    """All methods on standardised rows (id, label, features): assignments, composition, and their measures, best first."""
    from functools import reduce

    from callgrid.operators import fitted
    from callgrid.runtime import stage

    both = fitted.one_fold(rows.select("id", "label", "features"), rows.select("id", "label", "features"))
    scaled = stage(fitted.scale(both, "standard").where("is_test").select("id", "label", "features"), "cluster-rows")
    found = {"kmeans": k_means(scaled, n_clusters, seeds), "dbscan": dbscan(scaled, eps, least), "mean_shift": mean_shift(scaled)}
    staged = {m: stage(scaled.select("id", "label").join(t.select("id", F.col("cluster").cast("long").alias("cluster")), "id"), f"cluster-{m}") for m,
        t in found.items()}
    named = [t.select(F.lit(m).alias("method"), "*") for m, t in staged.items()]
    scores = reduce(DataFrame.unionByName, [measures(scaled, t).select(F.lit(m).alias("method"), "*") for m, t in staged.items()])
    every = reduce(DataFrame.unionByName, named)
    counted = every.groupBy("method", "cluster", "label").agg(F.count("*").alias("count")).orderBy("method", "cluster", F.desc("count"), "label")
    return {"assignments": every, "composition": counted, "measures": stage(scores, "cluster-measures").orderBy(F.desc("ami"), F.desc("ari"), "method")}


def composition(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster", "label").agg(F.count("*").alias("count")).orderBy("cluster", F.desc("count"), "label")


def contingency_measures(rows: DataFrame) -> DataFrame:
    """One row: homogeneity, completeness, NMI, ARI, noise fraction, over assigned rows (cluster not null)."""
    n_all = rows.agg(F.count("*").alias("all"), F.count("cluster").alias("assigned"))
    c = rows.where("cluster IS NOT NULL").groupBy("cluster", "label").agg(F.count("*").alias("n"))
    c = c.withColumns({"a": F.sum("n").over(W.partitionBy("cluster")), "b": F.sum("n").over(W.partitionBy("label")), "t": F.sum("n").over(W.partitionBy())})
    pairs = lambda x: x * (x - 1) / 2
    one = c.agg(
        F.sum(-(F.col("n") / F.col("t")) * F.log(F.col("b") / F.col("t"))).alias("h_label"),
            F.sum(-(F.col("n") / F.col("t")) * F.log(F.col("a") / F.col("t"))).alias("h_cluster"),
        F.sum((F.col("n") / F.col("t")) * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(pairs(F.col("n"))).alias("both"),
        F.sum(F.col("n") / F.col("a") * pairs(F.col("a"))).alias("same_cluster"), F.sum(F.col("n") / F.col("b") * pairs(F.col("b"))).alias("same_label"),
            F.max(pairs(F.col("t"))).alias("pairs"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    expected = F.col("same_cluster") * F.col("same_label") / F.col("pairs")
    return one.crossJoin(n_all).select(  # one row each
        share(F.col("mi"), F.col("h_label")).alias("homogeneity"), share(F.col("mi"), F.col("h_cluster")).alias("completeness"), share(2 * F.col("mi"),
            F.col("h_label") + F.col("h_cluster")).alias("nmi"),
        share(F.col("both") - expected, (F.col("same_cluster") + F.col("same_label")) / 2 - expected).alias("ari"),
            (1 - F.col("assigned") / F.col("all")).alias("noise_fraction"),
    )


def adjusted_mutual_information(table: np.ndarray) -> float:
    """AMI of a contingency matrix (clusters x labels), with the exact expectation under fixed margins."""
    n, a, b = table.sum(), table.sum(1), table.sum(0)
    log = lambda x: lgamma(x + 1)
    p = table[table > 0] / n
    outer = np.outer(a, b)[table > 0] / n**2
    mi = float((p * np.log(p / outer)).sum())
    h = [-float((x / n * np.log(x / n)).sum()) for x in (a[a > 0], b[b > 0])]
    expected = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            for k in range(max(1, x + y - int(n)), min(x, y) + 1):
                w = log(x) + log(y) + log(n - x) + log(n - y) - log(n) - log(k) - log(x - k) - log(y - k) - log(n - x - y + k)
                expected += k / n * np.log(n * k / (x * y)) * np.exp(w)
    top = np.mean(h) - expected
    return 1.0 if abs(top) < 1e-12 else (mi - expected) / top
