"""Cross-validation: folds are a column, so one plan evaluates all of them. Orders are seeded hashes, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GROUP_COLUMNS = ("domain", "site", "recording_id", "session_id", "dataset", "audio_path")


def shuffled(id_column: str, seed: int = 0) -> list[Column]:
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))), F.col(id_column)]


def stratified(rows: DataFrame, k: int, label: str = "label", id_column: str = "id", seed: int = 0) -> DataFrame:
    """Folds 0..k-1 that spread each label evenly."""
    nth = F.row_number().over(W.partitionBy(label).orderBy(*shuffled(id_column, seed)))
    return rows.withColumn("fold", ((nth - 1) % k).cast("int"))


def safe_k(rows: DataFrame, k: int, label: str = "label") -> int:
    """The number of folds that the smallest class allows, two at least."""
    least = rows.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return max(2, min(k, least))


def leave_one_group_out(rows: DataFrame, group: str) -> DataFrame:
    """One fold per group. Groups are ranked in their own small table."""
    ranks = rows.select(group).distinct().withColumn("fold", (F.dense_rank().over(W.orderBy(group)) - 1).cast("int"))
    return rows.join(ranks, rows[group].eqNullSafe(ranks[group]), "left").drop(ranks[group])


def group_folds(rows: DataFrame, k: int, group: str) -> DataFrame:
    """Whole groups, largest first, each to the fold that is smallest so far. The greedy walk is over the group table."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).collect()  # one row per group
    load, fold_of = [0] * k, []
    for r in sizes:
        f = load.index(min(load))
        load[f] += r["n"]
        fold_of.append((r[0], f))
    table = rows.sparkSession.createDataFrame(fold_of, f"{group} {dict(rows.dtypes)[group]}, fold int")
    return rows.join(table, rows[group].eqNullSafe(table[group]), "left").drop(table[group])


def stratified_groups(rows: DataFrame, k: int, group: str, label: str = "label") -> DataFrame:
    """Whole groups to folds so that label shares stay even: greedy over the group x label count table."""
    import numpy as np

    counts = rows.groupBy(group, label).count().collect()  # groups x labels
    labels = sorted({r[1] for r in counts}, key=str)
    by = {}
    for r in counts:
        by.setdefault(r[0], np.zeros(len(labels)))[labels.index(r[1])] += r[2]
    whole = np.maximum(1, sum(by.values()))
    load, fold_of = np.zeros((k, len(labels))), []
    for g, c in sorted(by.items(), key=lambda x: (-x[1].std(), str(x[0]))):
        cost = [(np.std(np.vstack([load[:f], load[f : f + 1] + c, load[f + 1 :]]) / whole, axis=0).mean(), load[f].sum(), f) for f in range(k)]
        f = min(cost)[2]
        load[f] += c
        fold_of.append((g, f))
    table = rows.sparkSession.createDataFrame(fold_of, f"{group} {dict(rows.dtypes)[group]}, fold int")
    return rows.join(table, rows[group].eqNullSafe(table[group]), "left").drop(table[group])


def group_column(rows: DataFrame, wanted: str | None = None) -> str | None:
    """The wanted column, or the first usual one, that has at least two values; null is a value."""
    from callgrid.operators.profile import distinct_with_null

    have = [c for c in ([wanted] if wanted else []) + list(GROUP_COLUMNS) if c in rows.columns]
    if not have:
        return None
    n = {r["column"]: r["n_distinct"] for r in distinct_with_null(rows, *dict.fromkeys(have)).collect()}
    return next((c for c in have if n[c] >= 2), None)


def scenarios(rows: DataFrame, k: int, group: str | None = None, primary: str | None = None, most_groups: int = 12) -> list[str]:
    """Names of the scenarios that the data allow, the primary one first."""
    n = rows.select(group).distinct().count() if group else 0
    found = (["leave_one_group_out"] if 2 <= n <= most_groups else []) + (["stratified_groups", "group_folds"] if n >= k else []) + ["stratified"]
    return sorted(found, key=lambda s: s != "stratified") if primary == "stratified_kfold" else found


def hold_out(rows: DataFrame, share: float = 0.2, label: str = "label", id_column: str = "id", seed: int = 0) -> DataFrame:
    """Column held_out: a stratified share of the rows."""
    rank = F.percent_rank().over(W.partitionBy(label).orderBy(*shuffled(id_column, seed)))
    return rows.withColumn("held_out", rank >= 1 - share)


def selection_split(rows: DataFrame, share: float = 0.25, group: str | None = None, label: str = "label", id_column: str = "id",
    seed: int = 0) -> tuple[DataFrame, str]:
    """(rows with column held_out, how): a share of the groups, one at least and not all, if there are several and both
    sides have two labels; else a stratified share; else rows at random."""
    if group:
        names = rows.select(group).distinct()
        n = names.count()
        if n > 1:
            k = max(1, min(n - 1, round(share * n)))
            chosen = names.orderBy(*shuffled(group, seed)).limit(k).select(F.col(group).alias("__group"), F.lit(True).alias("held_out"))
            out = rows.join(chosen, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group").withColumn("held_out", F.coalesce("held_out",
                F.lit(False)))
            sides = out.groupBy("held_out").agg(F.count_distinct(label).alias("labels")).agg(F.min("labels"), F.count("*")).first()
            if sides[0] is not None and sides[0] >= 2 and sides[1] == 2:
                return out, "group_shuffle"
    if (rows.groupBy(label).count().agg(F.min("count")).first()[0] or 0) >= 2:
        return hold_out(rows, share, label, id_column, seed), "stratified_shuffle"
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return rows.withColumn("held_out", u < share), "random"


def score_summary(scores: DataFrame, keys, *columns: str) -> DataFrame:
    """Mean, population deviation and minimum of fold scores."""
    return scores.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min))])
