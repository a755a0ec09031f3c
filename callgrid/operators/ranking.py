"""Ranking of search candidates: NaN never wins, ties are broken by id, test scores never take part."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.operators.sampling import best_of_group, coverage_first, first_n

CV_FOCUSED = (("weighted_f1", False), ("accuracy", False), ("macro_f1", False), ("macro_precision", False), ("weighted_f1_std", True))
DOMAIN_AWARE = (("domain_macro_f1", False), ("domain_accuracy", False), ("random_macro_f1", False), ("domain_macro_f1_std", True))


def order(keys=CV_FOCUSED, id_column: str = "candidate") -> list[Column]:
    """Sort keys with NaN as null and nulls last both ways."""
    clean = lambda c: F.when(~F.isnan(F.col(c)), F.col(c))
    return [clean(c).asc_nulls_last() if up else clean(c).desc_nulls_last() for c, up in keys] + [F.col(id_column).asc()]


def ranked(candidates: DataFrame, keys=CV_FOCUSED, id_column: str = "candidate") -> DataFrame:
    """All candidates in order. Candidate tables are search results: a row per tried configuration."""
    return candidates.orderBy(*order(keys, id_column))


def top(candidates: DataFrame, n: int, keys=CV_FOCUSED) -> DataFrame:
    return candidates.orderBy(*order(keys)).limit(n)


def best_per_feature_set(candidates: DataFrame, keys=CV_FOCUSED) -> DataFrame:
    return best_of_group(candidates, "feature_set", order(keys))


def top_feature_sets(candidates: DataFrame, n: int, keys=CV_FOCUSED) -> DataFrame:
    """The n best distinct feature sets: the best candidate of each, in order."""
    return first_n(candidates, ["feature_set"], order(keys), 1).orderBy(*order(keys)).limit(n)


def truncated(candidates: DataFrame, n: int, keys=CV_FOCUSED) -> DataFrame:
    return coverage_first(candidates, "feature_set", order(keys), n)


def pivoted(candidates: DataFrame, models, value: str = "macro_f1") -> DataFrame:
    """Best value by feature set (rows) and model (columns)."""
    return candidates.groupBy("feature_set").pivot("model", list(models)).agg(F.max(value)).orderBy("feature_set")


def compared(results: DataFrame, models, values=("macro_f1", "accuracy"), prefix: str = "official_test") -> DataFrame:
    """A row for each representation, a column for each model and value."""
    return results.groupBy("representation").pivot("model", list(models)).agg(*[F.max(f"{prefix}_{v}").alias(v) for v in values]).orderBy("representation")


def grid(spec: dict, seed: int = 0, limit: int | None = None) -> list[dict]:
    """All combinations of a parameter grid: cosine takes no tree search, p counts only for minkowski, repeats go, the
    order is shuffled by hash, and every feature set comes up before any comes twice."""
    import hashlib
    import json

    rows, seen = [], set()
    for values in product(*spec.values()):
        c = dict(zip(spec, values, strict=True))
        if c.get("metric") == "cosine" and c.get("algorithm") in ("ball_tree", "kd_tree"):
            continue
        if c.get("metric") != "minkowski" and "p" in c:
            c["p"] = 2
        text = json.dumps(c, sort_keys=True, default=str)
        if text not in seen:
            seen.add(text)
            rows.append((hashlib.md5(f"{seed}:{text}".encode()).hexdigest(), c))
    rows.sort(key=lambda r: r[0])
    nth: dict = {}
    keyed = []
    for at, (_, c) in enumerate(rows):
        n = nth[c.get("feature_set")] = nth.get(c.get("feature_set"), 0) + 1
        keyed.append((n > 1, at, c))
    return [c for _, _, c in sorted(keyed, key=lambda k: k[:2])][:limit]


def params_text(*columns: str) -> Column:
    """Parameters as JSON with sorted names."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def best_baseline(results: DataFrame) -> DataFrame:
    """The row with the best selection score; ties by family and model name, never by test scores."""
    return results.orderBy(F.desc("selection_macro_f1"), "family", "model").limit(1)
