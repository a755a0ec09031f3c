"""Registered queries of the engine's own operators over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.functions import labels as L
from callgrid.functions import scalars as S
from callgrid.functions import signal_sql as G
from callgrid.operators import folds, ingest, knn, leakage, metrics, prep, profile, ranking, sampling, temporal
from callgrid.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, -0.0 as 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def checked(spark, d):
    return ingest.checked(T.annotations(spark, d), T.ALIASES, T.DISPLAY)


def kept(spark, d):
    return ingest.manifest(checked(spark, d))


# ---- ingest -------------------------------------------------------------------------------------------------------

@query(f"""WITH {T.CHECKED_SQL} SELECT split, dataset, filename, label, source_row, round(clip_start_seconds, 6) AS clip_start_seconds,
  round(clip_end_seconds, 6) AS clip_end_seconds, round(clip_end_seconds - clip_start_seconds, 6) AS real_duration_seconds,
  CASE WHEN end_seconds <= audio_duration_seconds THEN 'ok' ELSE 'clipped_end' END AS quality_status FROM manifest""")
def q01_manifest_cascade(spark: SparkSession, d: str) -> DataFrame:
    return rounded(kept(spark, d).select("split", "dataset", "filename", "label", "source_row", "clip_start_seconds", "clip_end_seconds",
        "real_duration_seconds", "quality_status"))


@query(f"WITH {T.CHECKED_SQL} SELECT split, dataset, filename, label_raw, label, source_row AS row, issue FROM checked WHERE issue IS NOT NULL")
def q02_issue_rows(spark, d):
    return ingest.issues(checked(spark, d)).select("split", "dataset", "filename", "label_raw", "label", "row", "issue")


@query(f"WITH {T.CHECKED_SQL} SELECT issue, split, dataset, label, count(*) AS count FROM checked WHERE issue IS NOT NULL GROUP BY ALL")
def q03_quality_summary(spark, d):
    return profile.quality_summary(ingest.issues(checked(spark, d)))


@query(f"""WITH {T.CHECKED_SQL} SELECT quality_status, count(*) AS n, round(sum(real), 3) AS seconds
  FROM (SELECT CASE WHEN end_seconds <= audio_duration_seconds THEN 'ok' ELSE 'clipped_end' END AS quality_status, clip_end_seconds - clip_start_seconds AS real
  FROM manifest) GROUP BY 1""")
def q04_clip_interval(spark, d):
    return rounded(kept(spark, d).groupBy("quality_status").agg(F.count("*").alias("n"), F.sum("real_duration_seconds").alias("seconds")), 3)


def _counts_sql(*columns):
    return f"WITH {T.CHECKED_SQL} SELECT {', '.join(columns)}, count(*) AS count FROM manifest GROUP BY ALL"


@query(_counts_sql("split", "label"))
def q05_dist_split_label(spark, d):
    return profile.counts(kept(spark, d), "split", "label")


@query(_counts_sql("split"))
def q06_dist_split(spark, d):
    return profile.counts(kept(spark, d), "split")


@query(_counts_sql("split", "dataset"))
def q07_dist_split_dataset(spark, d):
    return profile.counts(kept(spark, d), "split", "dataset")


@query(_counts_sql("label"))
def q08_dist_overall(spark, d):
    return profile.counts(kept(spark, d), "label")


@query(f"""WITH {T.CHECKED_SQL} SELECT split, label, count(*) AS count,
  round(count(*) / sum(count(*)) OVER (PARTITION BY split), 6) AS fraction FROM manifest GROUP BY split, label""")
def q09_dist_fraction(spark, d):
    return rounded(profile.distribution(kept(spark, d), "label", ["split"]))


@query(f"""WITH {T.CHECKED_SQL} SELECT CASE WHEN grouping(split) = 1 THEN 'all' ELSE split END AS split, label, count(*) AS count
  FROM manifest GROUP BY GROUPING SETS ((split, label), (label))""")
def q10_dist_grouping_sets(spark, d):
    return profile.split_distribution(kept(spark, d))


@query(f"""WITH {T.CHECKED_SQL} SELECT split, max(n) AS largest, min(n) AS smallest, round(max(n) / min(n), 6) AS imbalance_ratio
  FROM (SELECT split, label, count(*) AS n FROM manifest GROUP BY ALL) GROUP BY split""")
def q11_imbalance_ratio(spark, d):
    return rounded(profile.imbalance_ratio(kept(spark, d), "label", ["split"]))


@query(f"""WITH {T.CHECKED_SQL} SELECT label, count(*) FILTER (split = 'train') AS train,
  count(*) FILTER (split = 'validation') AS validation FROM manifest GROUP BY label""")
def q12_crosstab(spark, d):
    return profile.crosstab(kept(spark, d), "label", "split", ["train", "validation"])


@query(f"""WITH {T.CHECKED_SQL} SELECT label_raw, label,
  CASE label WHEN 'view' THEN 'View' WHEN 'click' THEN 'Click' WHEN 'signup' THEN 'Sign-up' WHEN 'purchase' THEN 'Purchase' END AS label_display,
  count(*) AS n FROM labelled GROUP BY ALL""")
def q13_label_normalise(spark, d):
    return checked(spark, d).groupBy("label_raw", "label", "label_display").agg(F.count("*").alias("n"))


@query(f"""WITH {T.CHECKED_SQL} SELECT split, dataset, label,
  CASE WHEN label IN ('view', 'click') THEN 'browse' ELSE 'convert' END AS mapped, count(*) AS count FROM manifest GROUP BY ALL""")
def q14_label_family_counts(spark, d):
    return profile.label_audit(kept(spark, d), T.FAMILIES)


@query(f"""WITH {T.CHECKED_SQL}, l AS (SELECT *, floor(start_seconds / 600) AS slot FROM manifest), tr AS (SELECT * FROM l
  WHERE split = 'train'), te AS (SELECT * FROM l WHERE split = 'validation')
SELECT 'audio_path' AS "check", count(*) AS leaked_rows FROM tr WHERE audio_path IN (SELECT audio_path FROM te)
UNION ALL SELECT 'slot', count(*) FROM tr WHERE EXISTS (SELECT 1 FROM te WHERE te.label = tr.label AND te.slot = tr.slot)""")
def q15_leakage_counts(spark, d):
    rows = kept(spark, d).withColumn("slot", F.floor(F.col("start_seconds") / 600))
    return leakage.leakage_counts(rows, {"audio_path": ("audio_path",), "slot": ("label", "slot")})


@query(f"""WITH {T.CHECKED_SQL}, l AS (SELECT split, CAST(floor(start_seconds / 60) AS BIGINT) AS minute FROM manifest) SELECT minute FROM l
  WHERE split = 'train' INTERSECT SELECT minute FROM l WHERE split = 'validation'""")
def q16_key_overlap(spark, d):
    return leakage.key_overlap(kept(spark, d).withColumn("minute", F.floor(F.col("start_seconds") / 60)), "minute")


# ---- metrics ------------------------------------------------------------------------------------------------------

DENSE_SQL = f"""{T.PREDICTIONS_SQL}, dense AS (
  SELECT t.label AS "true", p.label AS pred, count(x.id) AS n FROM classes t CROSS JOIN classes p LEFT
  JOIN predictions x ON x.y_true_label = t.label AND x.y_pred_label = p.label GROUP BY ALL)"""
PER_CLASS_SQL = """
  SELECT {g} c.label, count(*) FILTER (y_true_label = c.label) AS support, count(*) FILTER (y_pred_label = c.label) AS predicted,
  count(*) FILTER (y_true_label = c.label AND y_pred_label = c.label) AS tp
  FROM predictions CROSS JOIN classes c GROUP BY {g} c.label"""
PRF_SQL = """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM ({inner}))"""


def _prf(g=""):
    return PRF_SQL.format(inner=PER_CLASS_SQL.format(g=g))


SUMMARY_SQL = """SELECT {g} sum(support)::BIGINT AS support, round(sum(tp) / sum(support), 6) AS accuracy,
  round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
  round(avg(f1) FILTER (support > 0), 6) AS present_macro_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy,
  round(avg(f1) FILTER (support > 0 OR predicted > 0), 6) AS macro_f1_fold, round(min(recall), 6) AS min_class_recall,
  round(sum(precision * support) / sum(support), 6) AS weighted_precision,
  round(sum(recall * support) / sum(support), 6) AS weighted_recall, round(sum(f1 * support) / sum(support), 6) AS weighted_f1"""


@query(f"WITH {DENSE_SQL} SELECT * FROM dense")
def q17_confusion_dense(spark, d):
    return metrics.confusion(T.predictions(spark, d), T.VECTOR_CLASSES)


@query(f"""WITH {DENSE_SQL} SELECT "true", pred, n, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY "true"), 0), 0), 6) AS share FROM dense""")
def q18_confusion_normalised(spark, d):
    return rounded(metrics.normalised_confusion(metrics.confusion(T.predictions(spark, d), T.VECTOR_CLASSES)))


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support, predicted, tp FROM ({_prf()})""")
def q19_per_class_prf(spark, d):
    return rounded(metrics.per_class(metrics.confusion(T.predictions(spark, d), T.VECTOR_CLASSES)))


@query(f"WITH {T.PREDICTIONS_SQL} {SUMMARY_SQL.format(g='')} FROM ({_prf()})")
def q20_summary_metrics(spark, d):
    return rounded(metrics.metrics(T.predictions(spark, d), T.VECTOR_CLASSES))


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT label, metric, round(score, 6) AS score
  FROM (SELECT label, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1, support::DOUBLE AS support
  FROM ({_prf()})) UNPIVOT (score FOR metric IN (precision, recall, f1, support))""")
def q21_report_unpivot(spark, d):
    return rounded(metrics.report_rows(metrics.per_class(metrics.confusion(T.predictions(spark, d), T.VECTOR_CLASSES))))


@query(f"WITH {T.PREDICTIONS_SQL} {SUMMARY_SQL.format(g='dataset,')} FROM ({_prf('dataset,')}) GROUP BY dataset")
def q22_metrics_by_domain(spark, d):
    return rounded(metrics.metrics(T.predictions(spark, d), T.VECTOR_CLASSES, ["dataset"]))


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT dataset, label, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support, predicted, tp FROM ({_prf('dataset,')})""")
def q23_metrics_by_domain_class(spark, d):
    return rounded(metrics.per_class(metrics.confusion(T.predictions(spark, d), T.VECTOR_CLASSES, ["dataset"]), ["dataset"]))


@query(f"WITH {T.PREDICTIONS_SQL} SELECT y_true_label, y_pred_label, count(*) AS count FROM predictions WHERE y_true_label <> y_pred_label GROUP BY ALL")
def q24_top_confusions(spark, d):
    return metrics.top_confusions(T.predictions(spark, d))


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT id, dataset, y_true_label, y_pred_label, round(pred_confidence, 6) AS pred_confidence
  FROM predictions WHERE (y_true_label = 'c1' AND y_pred_label = 'c3') OR (y_true_label = 'c3' AND y_pred_label = 'c1')""")
def q25_pair_confusion_report(spark, d):
    return rounded(metrics.pair_confusions(T.predictions(spark, d), "c1", "c3", True, ["id", "dataset", "y_true_label", "y_pred_label", "pred_confidence"]))


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT id, dataset, y_true_label, y_pred_label, round(pred_confidence, 6) AS pred_confidence
  FROM predictions WHERE y_true_label = 'c2' AND y_pred_label = 'c3'""")
def q26_oneway_confusion_report(spark, d):
    return rounded(metrics.pair_confusions(T.predictions(spark, d), "c2", "c3", False, ["id", "dataset", "y_true_label", "y_pred_label", "pred_confidence"]))


FAMILY_SQL = "CASE WHEN {c} IN ('c0','c1','c2','c3') THEN 'low' WHEN {c} IN ('c4','c5','c6') THEN 'middle' ELSE 'high' END"


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT {FAMILY_SQL.format(c='y_true_label')} AS family, y_true_label, y_pred_label, count(*) AS count
  FROM predictions
  WHERE y_true_label <> y_pred_label AND {FAMILY_SQL.format(c='y_true_label')} = {FAMILY_SQL.format(c='y_pred_label')} GROUP BY ALL""")
def q27_within_family_errors(spark, d):
    return metrics.within_family_errors(T.predictions(spark, d), T.VECTOR_FAMILIES)


@query(f"WITH {T.PREDICTIONS_SQL} SELECT label, support AS true_count, predicted AS pred_count, predicted - support AS delta FROM ({_prf()})")
def q28_pred_vs_true_delta(spark, d):
    return metrics.predicted_vs_true(T.predictions(spark, d), T.VECTOR_CLASSES)


@query(f"""WITH {T.PREDICTIONS_SQL} SELECT y_true_label AS label, count(*) AS support,
  round(avg((y_true_label = y_pred_label)::INT), 6) AS accuracy, round(avg(true_probability), 6) AS mean_true_probability,
  round(quantile_cont(true_probability, 0.5), 6) AS median_true_probability, round(avg(pred_confidence), 6) AS mean_confidence
  FROM predictions GROUP BY 1""")
def q29_confidence_analysis(spark, d):
    return rounded(metrics.confidence_analysis(T.predictions(spark, d), T.VECTOR_CLASSES))


@query(f"""WITH {T.PREDICTIONS_SQL}, best AS (SELECT y_true_label AS l FROM predictions JOIN classes ON label = y_true_label
  GROUP BY y_true_label, label_idx ORDER BY count(*) DESC, label_idx LIMIT 1) SELECT id, y_true_label, (SELECT l
  FROM best) AS y_pred_label FROM predictions""")
def q30_majority_baseline(spark, d):
    return metrics.majority_baseline(T.predictions(spark, d), T.VECTOR_CLASSES).select("id", "y_true_label", "y_pred_label")


@query(f"""WITH {T.PREDICTIONS_SQL}, s AS (SELECT y_pred_label AS label,
  round(pred_confidence, 2) AS score, (y_true_label = y_pred_label)::INT AS pos FROM predictions),
b AS (SELECT label, score, sum(pos) AS tp_here, count(*) AS n_here FROM s GROUP BY ALL), c AS (SELECT *,
  sum(tp_here) OVER w AS tp, sum(n_here) OVER w AS n, sum(tp_here) OVER (PARTITION BY label) AS total FROM b
  WINDOW w AS (PARTITION BY label ORDER BY score DESC))
SELECT label, score, round(tp / n, 6) AS precision, round(tp / total, 6) AS recall, round(tp / n * tp_here / total, 6) AS ap_part FROM c""")
def q32_pr_curve(spark, d):
    p = T.predictions(spark, d).select(F.col("y_pred_label").alias("label"), F.round("pred_confidence", 2).alias("score"),
        (F.col("y_true_label") == F.col("y_pred_label")).alias("positive"))
    return rounded(metrics.pr_curve(p))


# ---- neighbours ---------------------------------------------------------------------------------------------------

def _zip(expr):
    return f"list_transform(list_zip(q.features, t.features), lambda z: {expr})"


DISTANCE_SQL = {
    "euclidean": f"sqrt(list_sum({_zip('(z[1] - z[2]) * (z[1] - z[2])')}))", "manhattan": f"list_sum({_zip('abs(z[1] - z[2])')})",
        "chebyshev": f"list_max({_zip('abs(z[1] - z[2])')})",
    "minkowski": f"pow(list_sum({_zip('pow(abs(z[1] - z[2]), 3)')}), 1.0 / 3)",
    "cosine": f"1 - list_sum({_zip('z[1] * z[2]')}) / (sqrt(list_sum(list_transform(q.features, lambda x: x * x))) * sqrt(list_sum(list_transform(t.features, lambda x: x * x))))",
}


def _near_sql(metric, k=5):
    return f"""{T.VECTORS_SQL}, dist AS (SELECT q.id AS query_id, t.id AS neighbor_id, round({DISTANCE_SQL[metric]}, 9) AS distance
  FROM vectors q CROSS JOIN vectors t WHERE q.is_test AND NOT t.is_test),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM dist) WHERE rank <= {k})"""


def near(spark, d, metric="euclidean", k=5, p=2.0):
    v = T.vectors(spark, d)
    return knn.neighbours(v.where("NOT is_test"), v.where("is_test"), k, metric, p)


def _near_query(number, metric, p=2.0):
    def f(spark, d):
        return rounded(near(spark, d, metric, p=p))

    f.__name__ = f"q{number}_knn_{metric}"
    query(f"WITH {_near_sql(metric)} SELECT query_id, rank::INT AS rank, neighbor_id, round(distance, 6) AS distance FROM near")(f)


for _n, (_m, _p) in enumerate((("euclidean", 2.0), ("manhattan", 2.0), ("cosine", 2.0), ("chebyshev", 2.0), ("minkowski", 3.0)), 33):
    _near_query(_n, _m, _p)

VOTES_SQL = """, votes AS (SELECT query_id, label, sum({w}) AS vote FROM near JOIN vectors v ON v.id = neighbor_id GROUP BY ALL),
  shares AS (SELECT *, vote / sum(vote) OVER (PARTITION BY query_id) AS probability FROM votes)"""


@query(f"""WITH {_near_sql('euclidean')}{VOTES_SQL.format(w='1.0')} SELECT query_id, label, round(vote, 6) AS vote,
  round(probability, 6) AS probability FROM shares""")
def q38_knn_vote_uniform(spark, d):
    return rounded(knn.votes(near(spark, d), T.vectors(spark, d)))


@query(f"""WITH {_near_sql('manhattan')}{VOTES_SQL.format(w='CASE WHEN distance = 0 THEN 1 ELSE 1 / distance END')} SELECT query_id, label,
  round(vote, 6) AS vote, round(probability, 6) AS probability FROM shares""")
def q39_knn_vote_distance(spark, d):
    return rounded(knn.votes(near(spark, d, "manhattan"), T.vectors(spark, d), "distance"))


@query(f"""WITH {_near_sql('euclidean')}{VOTES_SQL.format(w='1.0')} SELECT query_id, label AS y_pred_label,
  round(probability, 6) AS pred_confidence FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY round(vote, 9) DESC, label) AS n FROM shares) WHERE n = 1""")
def q40_knn_classify(spark, d):
    return rounded(knn.classify(knn.votes(near(spark, d), T.vectors(spark, d)), T.VECTOR_CLASSES).select("query_id", "y_pred_label", "pred_confidence"))


@query(f"""WITH {_near_sql('euclidean')} SELECT query_id, string_agg(neighbor_id::VARCHAR, ' '
  ORDER BY rank) AS neighbor_ids, string_agg(label, ' ' ORDER BY rank) AS neighbor_labels, string_agg(domain, ' '
  ORDER BY rank) AS neighbor_domains, round(avg(distance), 6) AS mean_distance FROM near JOIN vectors v ON v.id = neighbor_id
  GROUP BY query_id""")
def q41_knn_neighbor_report(spark, d):
    return rounded(knn.neighbour_report(near(spark, d), T.vectors(spark, d)))


# ---- preprocessing ------------------------------------------------------------------------------------------------

CELLS_SQL = T.VECTORS_SQL + ", cells AS (SELECT id, is_test, unnest(features) AS x, generate_subscripts(features, 1) - 1 AS pos FROM vectors), fit AS (SELECT pos, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3 FROM cells WHERE NOT is_test GROUP BY pos)"


def _cells(spark, d, make, quantiles=None):
    v = T.vectors(spark, d)
    stats = prep.fetched(prep.statistics(v.where("NOT is_test"), quantiles=quantiles))
    return rounded(v.select("id", F.posexplode(make(F.col("features"), stats)).alias("pos", "x")))


def _holed(features):
    return F.transform(features, lambda x, i: F.when((i + 1) % 10 == 3, F.lit(float("nan"))).when(i % 10 == 7, F.lit(None)).otherwise(x))


HOLED_SQL = "CASE WHEN (pos + 1) % 10 = 3 OR pos % 10 = 7 THEN {fill} ELSE x END"


@query(f"WITH {CELLS_SQL} SELECT id, pos::INT AS pos, round({HOLED_SQL.format(fill='mean')}, 6) + 0.0 AS x FROM cells JOIN fit USING (pos)")
def q42_impute_mean(spark, d):
    return _cells(spark, d, lambda x, s: prep.impute(_holed(x), s, "mean"))


@query(f"WITH {CELLS_SQL} SELECT id, pos::INT AS pos, round({HOLED_SQL.format(fill='q2')}, 6) + 0.0 AS x FROM cells JOIN fit USING (pos)")
def q43_impute_median(spark, d):
    return _cells(spark, d, lambda x, s: prep.impute(_holed(x), s, "median"), prep.QUARTILES)


@query(f"WITH {CELLS_SQL} SELECT id, pos::INT AS pos, round((x - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) + 0.0 AS x FROM cells JOIN fit USING (pos)")
def q44_scale_standard(spark, d):
    return _cells(spark, d, lambda x, s: prep.scale(x, s, "standard"))


@query(f"""WITH {CELLS_SQL} SELECT id, pos::INT AS pos, round((x - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END, 6) + 0.0 AS x FROM cells
  JOIN fit USING (pos)""")
def q45_scale_robust(spark, d):
    return _cells(spark, d, lambda x, s: prep.scale(x, s, "robust"), prep.QUARTILES)


@query(f"""WITH {CELLS_SQL} SELECT id, pos::INT AS pos, round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) + 0.0 AS x FROM cells
  JOIN fit USING (pos)""")
def q46_scale_minmax(spark, d):
    return _cells(spark, d, lambda x, s: prep.scale(x, s, "minmax"))


@query(f"WITH {CELLS_SQL} SELECT id, pos::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) + 0.0 AS x FROM cells")
def q47_normalise_l2(spark, d):
    return _cells(spark, d, lambda x, s: prep.l2_normalised(x))


@query(f"WITH {CELLS_SQL} SELECT pos::INT AS pos, round(std * std, 6) + 0.0 AS variance, std * std > 0.0155 AS kept FROM fit")
def q48_variance_threshold(spark, d):
    stats = prep.statistics(T.vectors(spark, d).where("NOT is_test"), quantiles=None)
    positions = prep.variance_kept(prep.fetched(stats), 0.0155)
    return rounded(stats.select("pos", (F.col("std") * F.col("std")).alias("variance"), F.col("pos").isin(*positions).alias("kept")))


@query()
def q50_pca_topk(spark, d):
    v = T.vectors(spark, d)
    stats = prep.fetched(prep.statistics(v, quantiles=None))
    components, _ = prep.principal_components(prep.covariance(v, stats), 4)
    return v.select("id", F.posexplode(prep.projected(F.col("features"), stats, components)).alias("component", "x"))


@query()
def q51_select_k_best_mi(spark, d):
    return prep.select_k_best(T.vectors(spark, d), 16)


@query()
def q52_power_lambdas(spark, d):
    return prep.power_lambdas(T.vectors(spark, d))


# ---- temporal -----------------------------------------------------------------------------------------------------

@query(f"""WITH {T.INTERVALS_SQL},
  marked AS (SELECT audio_path, label, gt_id, unnest(range(greatest(0, floor(start / 4)::BIGINT), least(ceil("end" / 4)::BIGINT, ceil({T.DAY_END} / 4)::BIGINT))) AS frame
  FROM intervals)
SELECT audio_path, frame, max_by(label, gt_id) AS label FROM marked GROUP BY ALL""")
def q53_frame_labels(spark, d):
    rows = T.intervals(spark, d).withColumn("duration", F.lit(T.DAY_END))
    return temporal.frame_labels(rows, "duration", 0.25, "gt_id")


ISLANDS = temporal.DetectorConfig(0.25, 8.0, 0.5, True, T.CLASSES)


def predicted_frames(spark, d):
    """Marked frames with their class as prediction and a confidence by frame number."""
    rows = T.intervals(spark, d).withColumns({"duration": F.lit(T.DAY_END), "label": F.coalesce(L.code(F.col("label"), T.CLASSES) + 1, F.lit(0))})
    frames = temporal.frame_labels(rows, "duration", 0.25, "gt_id")
    confidence = F.when(F.col("frame") % 10 == 0, 0.4).otherwise(0.5 + (F.col("frame") % 5) / 10)
    return frames.select("audio_path", "frame", F.col("label").alias("pred"), confidence.alias("confidence"))


@query(f"""WITH {T.INTERVALS_SQL}, marked AS (SELECT audio_path, gt_id,
  CASE label WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS c, unnest(range(greatest(0, floor(start / 4)::BIGINT), least(ceil("end" / 4)::BIGINT, ceil({T.DAY_END} / 4)::BIGINT))) AS frame
  FROM intervals),
f AS (SELECT audio_path, frame, max_by(c, gt_id) AS pred FROM marked GROUP BY ALL), kept AS (SELECT *,
  CASE WHEN frame % 10 = 0 THEN 0.4 ELSE 0.5 + (frame % 5) / 10 END AS confidence FROM f),
  o AS (SELECT *, frame - row_number() OVER (PARTITION BY audio_path ORDER BY frame) AS run FROM kept WHERE pred > 0 AND confidence >= 0.5),
n AS (SELECT audio_path, run, pred, count(*) AS k FROM o GROUP BY ALL), m AS (SELECT audio_path, run, pred
  FROM (SELECT *, row_number() OVER (PARTITION BY audio_path, run ORDER BY k DESC, pred) AS r FROM n) WHERE r = 1),
g AS (SELECT audio_path, run, min(frame) AS a, max(frame) AS b, avg(confidence) AS confidence FROM o GROUP BY ALL)
SELECT audio_path, round(a / 0.25, 6) AS start,
  round((b + 1) / 0.25, 6) AS "end", ['view', 'click', 'signup', 'purchase'][pred] AS label, round(confidence, 6) AS confidence
  FROM g JOIN m USING (audio_path, run) WHERE (b - a + 1) / 0.25 >= 8""")
def q54_islands(spark, d):
    return rounded(temporal.islands(predicted_frames(spark, d), ISLANDS))


IOU_SQL = f"""{T.INTERVALS_SQL},
  pairs AS (SELECT p.audio_path, p.gt_id AS gt_of, pred_id, g.gt_id, (least(p."end", g."end") - greatest(p.start, g.start)) / (greatest(p."end", g."end") - least(p.start, g.start)) AS iou
  FROM (SELECT *, pred_id AS gt_id FROM detections) p
  JOIN intervals g ON p.audio_path = g.audio_path AND p.start < g."end" AND g.start < p."end" AND p."end" > p.start AND g."end" > g.start)"""


@query(f"WITH {IOU_SQL} SELECT audio_path, pred_id, gt_id, round(iou, 6) AS iou FROM pairs")
def q55_iou_pairs(spark, d):
    return rounded(temporal.overlaps(T.detections(spark, d), T.intervals(spark, d)))


MATCH_SQL = f"""{IOU_SQL}, best AS (SELECT * FROM (SELECT audio_path, pred_id, gt_id,
  round(iou, 9) AS iou, row_number() OVER (PARTITION BY audio_path, pred_id ORDER BY round(iou, 9) DESC, gt_id) AS n FROM pairs) WHERE n = 1),
thresholds AS (SELECT unnest([0.5, 0.75, 0.9]::DOUBLE[]) AS threshold), matched AS (SELECT *
  FROM (SELECT audio_path, threshold, pred_id, gt_id, iou, row_number() OVER (PARTITION BY audio_path, threshold, gt_id
  ORDER BY pred_id) AS k FROM best JOIN thresholds ON iou >= threshold) WHERE k = 1)"""


@query(f"WITH {MATCH_SQL} SELECT audio_path, threshold, pred_id, gt_id, round(iou, 6) AS iou FROM matched")
def q56_greedy_match(spark, d):
    return rounded(temporal.matches(T.detections(spark, d), T.intervals(spark, d), (0.5, 0.75, 0.9)))


FILES_SQL = f"""{MATCH_SQL}, files AS (SELECT audio_path, coalesce(g.n, 0) AS gt, coalesce(p.n, 0) AS detected FROM (SELECT audio_path,
  count(*) AS n FROM intervals GROUP BY 1) g FULL JOIN (SELECT audio_path, count(*) AS n FROM detections GROUP BY 1) p USING (audio_path)),
hits AS (SELECT audio_path, threshold, count(*) AS tp, avg(iou) AS mean_iou FROM matched GROUP BY ALL),
  per_file AS (SELECT f.audio_path, t.threshold, gt, detected, coalesce(tp, 0) AS tp, detected - coalesce(tp, 0) AS fp, gt - coalesce(tp, 0) AS fn, coalesce(mean_iou, 0) AS mean_iou
  FROM files f CROSS JOIN thresholds t LEFT JOIN hits h ON h.audio_path = f.audio_path AND h.threshold = t.threshold)"""


@query(f"WITH {FILES_SQL} SELECT audio_path, threshold, gt, detected, tp, fp, fn, round(mean_iou, 6) AS mean_iou FROM per_file")
def q57_detection_files(spark, d):
    return rounded(temporal.file_summary(T.detections(spark, d), T.intervals(spark, d), (0.5, 0.75, 0.9)))


@query(f"""WITH {FILES_SQL}, s AS (SELECT threshold, count(*) AS files, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp,
  sum(fn)::BIGINT AS fn, avg(mean_iou) AS m FROM per_file GROUP BY 1) SELECT threshold, files, tp, fp, fn, round(m, 6) AS mean_iou,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM s""")
def q58_iou_thresholds(spark, d):
    return rounded(temporal.totals(temporal.file_summary(T.detections(spark, d), T.intervals(spark, d), (0.5, 0.75, 0.9))))


# ---- folds, ranking -----------------------------------------------------------------------------------------------

@query(f"WITH {T.VECTORS_SQL} SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('0:' || id), id) - 1) % 5)::INT AS fold FROM vectors")
def q59_stratified_folds(spark, d):
    return folds.stratified(T.vectors(spark, d).select("id", "label"), 5)


@query(f"WITH {T.VECTORS_SQL} SELECT id, domain, (dense_rank() OVER (ORDER BY domain) - 1)::INT AS fold FROM vectors")
def q60_logo_folds(spark, d):
    return folds.leave_one_group_out(T.vectors(spark, d).select("id", "domain"), "domain")


@query(f"""WITH {T.PREDICTIONS_SQL}, s AS (SELECT dataset, y_true_label, avg((y_true_label = y_pred_label)::INT) AS accuracy FROM predictions
  GROUP BY ALL) SELECT dataset, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std,
  round(min(accuracy), 6) AS accuracy_min FROM s GROUP BY dataset""")
def q62_cv_scores(spark, d):
    s = T.predictions(spark, d).groupBy("dataset", "y_true_label").agg(F.avg((F.col("y_true_label") == F.col("y_pred_label")).cast("double")).alias("accuracy"))
    return rounded(folds.score_summary(s, ["dataset"], "accuracy"))


def candidates(spark, d):
    """Search results made of parts: a candidate each, with ties and NaN."""
    p = T.table(spark, d, "part")
    i = F.col("p_partkey")
    return p.select(i.alias("candidate"), F.col("p_brand").alias("feature_set"), F.concat(F.lit("m"), (i % 4).cast("string")).alias("model"),
        F.when(i % 17 == 0, float("nan")).otherwise((i * 37 % 101) / 100).alias("weighted_f1"), ((i * 53 % 89) / 100).alias("accuracy"),
            ((i * 29 % 97) / 100).alias("macro_f1"), ((i * 11 % 83) / 100).alias("macro_precision"), ((i * 7 % 31) / 100).alias("weighted_f1_std"))


CANDIDATES_SQL = """c AS (SELECT p_partkey AS candidate, p_brand AS feature_set, 'm' || (p_partkey % 4) AS model,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey * 37 % 101) / 100 END AS weighted_f1, (p_partkey * 53 % 89) / 100 AS accuracy, (p_partkey * 29 % 97) / 100 AS macro_f1, (p_partkey * 11 % 83) / 100 AS macro_precision, (p_partkey * 7 % 31) / 100 AS weighted_f1_std
  FROM part)"""
ORDER_SQL = "weighted_f1 DESC NULLS LAST, accuracy DESC, macro_f1 DESC, macro_precision DESC, weighted_f1_std, candidate"


@query(f"WITH {CANDIDATES_SQL} SELECT candidate, feature_set, row_number() OVER (ORDER BY {ORDER_SQL})::INT AS place FROM c ORDER BY {ORDER_SQL} LIMIT 100")
def q63_rank_candidates(spark, d):
    best = ranking.top(candidates(spark, d), 100)
    return best.select("candidate", "feature_set", F.row_number().over(W.orderBy(*ranking.order())).alias("place"))  # a top-100 report


@query(f"""WITH {CANDIDATES_SQL} SELECT feature_set, candidate, n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY feature_set
  ORDER BY {ORDER_SQL}) AS n, count(*) OVER (PARTITION BY feature_set) AS n_candidates FROM c) WHERE n = 1""")
def q64_best_per_feature_set(spark, d):
    return ranking.best_per_feature_set(candidates(spark, d)).select("feature_set", "candidate", "n_candidates")


@query(f"""WITH {CANDIDATES_SQL} SELECT candidate, feature_set FROM (SELECT *, row_number() OVER (PARTITION BY feature_set
  ORDER BY {ORDER_SQL}) > 1 AS later FROM c) ORDER BY later, {ORDER_SQL} LIMIT 60""")
def q65_coverage_truncation(spark, d):
    return ranking.truncated(candidates(spark, d), 60).select("candidate", "feature_set")


@query(f"""WITH {CANDIDATES_SQL}
  SELECT feature_set, {', '.join(f'round(max(macro_f1) FILTER (model = {chr(39)}m{i}{chr(39)}), 6) AS m{i}' for i in range(4))}
  FROM c GROUP BY feature_set""")
def q66_pivot_results(spark, d):
    return rounded(ranking.pivoted(candidates(spark, d), ["m0", "m1", "m2", "m3"]))


# ---- signals ------------------------------------------------------------------------------------------------------

RATE, N = 250.0, 64
DFT_SQL = f"""{T.VECTORS_SQL},
  spectrum AS (SELECT id, features AS x, list_transform(range(0, {N // 2
      + 1}), lambda k: pow(list_sum(list_transform(features, lambda v, i: v * cos(-2 * pi() / {N} * k * (i - 1)))), 2) + pow(list_sum(list_transform(features, lambda v, i: v * sin(-2 * pi() / {N} * k * (i - 1)))), 2)) AS p
  FROM vectors),
bins AS (SELECT id, unnest(p) AS p, (generate_subscripts(p, 1) - 1) AS k, (generate_subscripts(p, 1) - 1) * {RATE / N} AS f FROM spectrum)"""


def spectra(spark, d):
    v = T.vectors(spark, d).select("id", F.col("features").alias("x"))
    return v.withColumns({"p": G.power_spectrum(F.col("x"), N)}).withColumn("f", G.frequencies(N, RATE))


@query(f"WITH {DFT_SQL} SELECT id, k::INT AS bin, round(p, 6) + 0.0 AS power FROM bins")
def q67_dft_power(spark, d):
    return rounded(spectra(spark, d).select("id", F.posexplode("p").alias("bin", "power")))


@query(f"""WITH {DFT_SQL}, c AS (SELECT id, sum(p * f) / sum(p) AS c FROM bins GROUP BY id) SELECT id, round(any_value(c), 4) AS centroid,
  round(sqrt(sum(p * (f - c) * (f - c)) / sum(p)), 4) AS bandwidth FROM bins JOIN c USING (id) GROUP BY id""")
def q68_centroid_bandwidth(spark, d):
    return rounded(spectra(spark, d).select("id", G.centroid(F.col("p"), F.col("f")).alias("centroid"), G.bandwidth(F.col("p"),
        F.col("f")).alias("bandwidth")), 4)


@query(f"""WITH {DFT_SQL}, c AS (SELECT id, f, sum(p) OVER (PARTITION BY id ORDER BY k) AS s, sum(p) OVER (PARTITION BY id) AS t FROM bins)
  SELECT id, min(f) FILTER (s >= t * 0.85) AS rolloff FROM c GROUP BY id""")
def q69_rolloff85(spark, d):
    return spectra(spark, d).select("id", G.rolloff(F.col("p"), F.col("f")).alias("rolloff"))


@query(f"""WITH {DFT_SQL}, s AS (SELECT id, p / sum(p) OVER (PARTITION BY id) AS q FROM bins) SELECT id,
  round(-sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) / log2({N // 2 + 1}), 6) AS entropy FROM s GROUP BY id""")
def q70_spectral_entropy(spark, d):
    return rounded(spectra(spark, d).select("id", S.entropy_share(F.col("p")).alias("entropy")))


@query(f"""WITH {DFT_SQL} SELECT id, round(sum(p) FILTER (f >= 15 AND f < 35), 5) AS low,
  round(sum(p) FILTER (f >= 35 AND f < 90), 5) AS middle FROM bins GROUP BY id""")
def q71_band_energy(spark, d):
    return rounded(spectra(spark, d).select("id", G.band_energy(F.col("p"), F.col("f"), 15, 35).alias("low"), G.band_energy(F.col("p"), F.col("f"), 35,
        90).alias("middle")), 5)


@query(f"WITH {DFT_SQL} SELECT id, arg_max(f, round(p, 9) - k * 1e-12) AS dominant FROM bins GROUP BY id")
def q72_dominant_frequency(spark, d):
    return spectra(spark, d).select("id", F.get(F.col("f"), S.argmax(F.transform("p", lambda x: F.round(x, 9)))).alias("dominant"))


@query(f"""WITH {T.VECTORS_SQL}, fr AS (SELECT id, unnest(range(0, 7)) AS frame, features FROM vectors) SELECT id, frame::INT AS frame,
  round(sqrt(list_sum(list_transform(features[frame * 8 + 1:frame * 8 + 16], lambda v: v * v)) / 16), 6) AS rms FROM fr""")
def q73_framed_rms(spark, d):
    v = T.vectors(spark, d).select("id", F.posexplode(G.framed(F.col("features"), 16, 8)).alias("frame", "x"))
    return rounded(v.select("id", "frame", G.rms(F.col("x")).alias("rms")))


@query(f"""WITH {CELLS_SQL}, s AS (SELECT id, (x < 0) <> (lag(x) OVER (PARTITION BY id ORDER BY pos) < 0) AS turn FROM cells) SELECT id,
  round(count(*) FILTER (turn) / 63, 6) AS zcr FROM s GROUP BY id""")
def q74_zero_crossings(spark, d):
    return rounded(T.vectors(spark, d).select("id", G.zero_crossing_rate(F.col("features")).alias("zcr")))


@query(f"""WITH {CELLS_SQL} SELECT id, pos::INT AS pos, round(x - coalesce(lag(x) OVER w, x), 6) + 0.0 AS delta,
  round((coalesce(lag(x) OVER w, 0) + x + coalesce(lead(x) OVER w, 0)) / 3, 6) + 0.0 AS smooth FROM cells
  WINDOW w AS (PARTITION BY id ORDER BY pos)""")
def q75_difference_smooth(spark, d):
    v = T.vectors(spark, d).select("id", F.posexplode(F.arrays_zip(G.difference(F.col("features")).alias("delta"),
        G.moving_average(F.col("features")).alias("smooth"))).alias("pos", "x"))
    return rounded(v.select("id", "pos", F.col("x.delta").alias("delta"), F.col("x.smooth").alias("smooth")))


@query(f"""WITH {CELLS_SQL}, n AS (SELECT id, x, ntile(7) OVER (PARTITION BY id ORDER BY pos) - 1 AS part FROM cells)
  SELECT id, part::INT AS part, round(avg(x), 6) + 0.0 AS mean, round(max(x), 6) + 0.0 AS highest FROM n GROUP BY ALL""")
def q76_chunk_stats(spark, d):
    v = T.vectors(spark, d).select("id", F.posexplode(G.chunks(F.col("features"), 7)).alias("part", "x"))
    return rounded(v.select("id", "part", S.mean(F.col("x")).alias("mean"), F.array_max("x").alias("highest")))


@query(f"""WITH {CELLS_SQL}, h AS (SELECT id, least(7, floor(abs(x) * 4)) AS bin, abs(x) AS w FROM cells WHERE abs(x) * 4 / 8 <= 1)
  SELECT v.id, b::INT AS bin, round(coalesce(sum(w), 0), 6) AS weight FROM vectors v CROSS JOIN range(8) r(b) LEFT
  JOIN h ON h.id = v.id AND h.bin = b GROUP BY ALL""")
def q77_weighted_histogram(spark, d):
    a = F.transform("features", F.abs)
    a = F.filter(a, lambda x: x * 4 / 8 <= 1)
    v = T.vectors(spark, d).select("id", F.posexplode(G.weighted_histogram(F.transform(a, lambda x: x / 2), a, 8)).alias("bin", "weight"))
    return rounded(v)


# ---- samples and weights ------------------------------------------------------------------------------------------

@query(f"""WITH {T.CHECKED_SQL} SELECT label, source_row FROM (SELECT label, source_row, row_number() OVER (PARTITION BY label
  ORDER BY dataset, filename, source_row) AS n FROM manifest) WHERE n <= 25""")
def q78_first_n_per_class(spark, d):
    return sampling.first_n(kept(spark, d), ["label"], ["dataset", "filename", "source_row"], 25).select("label", "source_row")


@query(f"""WITH {T.CHECKED_SQL} SELECT label, source_row FROM (SELECT label, source_row, row_number() OVER (PARTITION BY label
  ORDER BY md5('0:' || source_row), source_row) AS n FROM manifest) WHERE n <= 25""")
def q79_random_n_per_class(spark, d):
    return sampling.random_n(kept(spark, d), ["label"], "source_row", 25).select("label", "source_row")


WEIGHTS_SQL = f"""{T.CHECKED_SQL}, n AS (SELECT label, count(*) AS c FROM manifest GROUP BY 1), w AS (SELECT label, c,
  sum(c) OVER () / greatest(1, c) AS w FROM n),
  v AS (SELECT label, c, w / avg(w) OVER () * CASE WHEN label = 'purchase' THEN 3 ELSE 1 END AS w FROM w),
  u AS (SELECT label, c, w / avg(w) OVER () AS weight FROM v)"""


@query(f"WITH {WEIGHTS_SQL} SELECT label, c AS count, round(weight, 6) AS weight FROM u")
def q80_class_weights(spark, d):
    return rounded(profile.class_weights(kept(spark, d), T.CLASSES, {"purchase": 3}).select("label", "count", "weight"))


@query(f"WITH {WEIGHTS_SQL} SELECT source_row, label, round(weight, 6) AS weight FROM manifest JOIN u USING (label)")
def q81_sample_weights(spark, d):
    rows = kept(spark, d)
    return rounded(profile.sample_weights(rows, profile.class_weights(rows, T.CLASSES, {"purchase": 3})).select("source_row", "label", "weight"))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%S') || '_000.wav' AS filename, ts FROM events)
  SELECT event_id, filename, round(epoch(date_trunc('second', ts)) - epoch(date_trunc('day', ts)), 6) AS offset_seconds FROM t""")
def q82_parse_times(spark, d):
    e = T.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    name = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("_000.wav"))
    return rounded(e.select("event_id", name.alias("filename"), S.seconds_between(F.date_trunc("day", "ts"), S.audio_start(name)).alias("offset_seconds")))


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents")
def q83_content_hashes(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1(F.encode("text", "UTF-8")).alias("sha1"))


@query("""SELECT p_partkey AS id, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel,
  round(10 * log10(greatest(p_retailprice / 1000, 1e-10)), 6) AS db,
  round(greatest(0, least(p_size + 5, 30) - greatest(p_size, 20)) / (greatest(p_size + 5, 30) - least(p_size, 20)), 6) AS iou FROM part""")
def q84_scalar_functions(spark, d):
    x = F.col("p_retailprice")
    a, b = F.col("p_size").cast("double"), F.col("p_size") + 5.0
    return rounded(T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.hz_to_mel(x).alias("mel"), S.decibels(x / 1000).alias("db"),
        S.temporal_iou(a, b, F.lit(20.0), F.lit(30.0)).alias("iou")))


# ---- flows, clustering, vectors, streams (not expressible in SQL unless a text is given) --------------------------

@query()
def q85_submission_summary(spark, d):
    from callgrid.plans.pipelines import submission

    return rounded(submission(T.vectors(spark, d), T.VECTOR_CLASSES, {"scaler": "robust_l2", "k": 5})["summary"])


@query()
def q86_search_table(spark, d):
    from callgrid.plans.pipelines import search

    rows = {"raw": T.vectors(spark, d)}
    grid = ranking.grid({"feature_set": ["raw"], "scaler": ["standard", "l2"], "k": [1, 5], "metric": ["cosine"]})
    return rounded(search(rows, T.VECTOR_CLASSES, grid, domain_aware=True).drop("params"))


@query()
def q87_kmeans_composition(spark, d):
    from callgrid.operators import clustering

    return clustering.composition(clustering.k_means(T.vectors(spark, d), 10, seeds=2))


@query(f"""WITH {T.PREDICTIONS_SQL}, c AS (SELECT y_pred_label AS cluster, y_true_label AS label, count(*) AS n FROM predictions
  GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY cluster) AS a, sum(n) OVER (PARTITION BY label) AS b, sum(n) OVER () AS t
  FROM c), s AS (SELECT sum(-n / t * ln(b / t)) AS hl, sum(-n / t * ln(a / t)) AS hc, sum(n / t * ln(n * t / (a * b))) AS mi,
  sum(n * (n - 1) / 2) AS both_, sum(n / a * a * (a - 1) / 2) AS sc,
  sum(n / b * b * (b - 1) / 2) AS sl, max(t * (t - 1) / 2) AS pairs FROM m) SELECT round(mi / hl, 6) AS homogeneity,
  round(mi / hc, 6) AS completeness, round(2 * mi / (hl + hc), 6) AS nmi,
  round((both_ - sc * sl / pairs) / ((sc + sl) / 2 - sc * sl / pairs), 6) AS ari, 0.0::DOUBLE AS noise_fraction FROM s""")
def q89_contingency_measures(spark, d):
    from callgrid.operators import clustering

    p = T.predictions(spark, d).select(F.col("y_pred_label").alias("cluster"), F.col("y_true_label").alias("label"))
    return rounded(clustering.contingency_measures(p))


@query()
def q90_baseline_models(spark, d):
    """Six of the nine baselines, in sizes that suit a query (README); the tests run all nine."""
    from callgrid.plans import baselines

    names = ("logistic_regression", "knn", "gaussian_nb", "decision_tree_pruned", "random_forest", "mlp")
    small = {"trees": 20, "depth": 8, "lr_iterations": 100, "mlp_iterations": 50}
    out = baselines.compare({"raw": T.vectors(spark, d)}, T.VECTOR_CLASSES, names, sizes=small)
    return rounded(out["results"].drop("selection_method"))


def sounding(spark, d):
    """Embeddings as 64 samples at 250 Hz with an event box."""
    v = T.table(spark, d, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples"), F.lit(250).alias("rate"), F.lit(0.0).alias("clip_start_seconds"),
        F.lit(0.256).alias("clip_end_seconds"), F.lit(0.256).alias("duration_seconds"), F.lit(0.256).alias("real_duration_seconds"), (F.col("label") * 5.0
            + 10).alias("low_frequency"), (F.col("label") * 5.0 + 40).alias("high_frequency"))


AUDIO = {"sample_rate": 250, "n_fft": 32, "win_length": 32, "hop_length": 8, "n_mels": 16, "f_min": 0, "f_max": 125, "frequency_scale": "linear",
    "normalization": "sample"}


def _vectors_query(number, name):
    def f(spark, d):
        from callgrid.functions.features import extract

        return extract(sounding(spark, d), name, AUDIO)

    f.__name__ = f"q{number}_features_{name}"
    query()(f)


for _n, _name in enumerate(("handcrafted_stats", "waveform_spectral_stats", "lowfreq_all", "notebook_exact_44_plus_regions", "mfcc_20", "logmel_stats_32",
    "band_energy_mel_16", "patch_32x32", "classical_texture_32x32"), 91):
    _vectors_query(_n, _name)


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS start, date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR AS "end", event_type,
  count(*) AS n, round(sum(value), 3) AS value FROM events GROUP BY ALL""")
def q100_windowed_counts(spark, d):
    from callgrid.streaming.detections import windowed_counts

    out = windowed_counts(T.table(spark, d, "events"))
    return rounded(out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")}), 3)


@query(f"""WITH {T.CHECKED_SQL} SELECT 'label' AS "column", count(DISTINCT label) + max((label IS NULL)::INT) AS n_distinct FROM checked
  UNION ALL SELECT 'dataset', count(DISTINCT dataset) + max((dataset IS NULL)::INT) FROM checked""")
def q102_distinct_with_null(spark, d):
    return profile.distinct_with_null(checked(spark, d), "label", "dataset")


@query(f"WITH {T.VECTORS_SQL} SELECT id, label, percent_rank() OVER (PARTITION BY label ORDER BY md5('0:' || id), id) >= 0.8 AS held_out FROM vectors")
def q103_hold_out(spark, d):
    return folds.hold_out(T.vectors(spark, d).select("id", "label"))
