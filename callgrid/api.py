"""The engine for notebooks: its flows by name, over paths. Each call makes or takes the running session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.functions.labels import CLASSES, FAMILIES
from callgrid.operators import clustering as C
from callgrid.operators import ingest, leakage, sampling
from callgrid.plans import audits, diagnostics, pipelines
from callgrid.plans import baselines as B
from callgrid.plans import search as S
from callgrid.runtime import stage
from callgrid.session import session
from callgrid.sources import annotations, config, images, sinks, wav


def settings(path: str) -> dict:
    """A configuration file with its audio preset resolved."""
    c = config.load(path)
    return c | {"audio": config.with_preset(c.get("audio") or {})}


def manifest(path: str) -> DataFrame:
    """A manifest from Parquet or CSV."""
    spark = session()
    return annotations.manifest_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def build_manifest(data_root: str, out: str, splits=("train", "validation"), min_valid_seconds: float = 0.5) -> tuple[DataFrame, DataFrame]:
    rows, issues = annotations.build_manifest(session(), data_root, splits, min_valid_seconds)
    rows.write.mode("overwrite").parquet(out)
    return session().read.parquet(out), issues


def events(rows: DataFrame, aggregation: dict | None = None) -> DataFrame:
    """Valid events with an id, a domain and, where wanted, aggregated labels."""
    from callgrid.functions.labels import aggregated

    out = ingest.valid_rows(rows).withColumns({"id": F.xxhash64("split", "dataset", "filename", "source_row"), "domain": F.col("dataset"),
        "is_test": F.col("split") == "validation"})
    return out.withColumn("label", aggregated(F.col("label"), aggregation)) if aggregation else out


def feature_table(rows: DataFrame, data_root: str, name, cfg: dict) -> DataFrame:
    """(id, label, domain, is_test, features) of events by their files, staged: samples are read and vectors made once,
    however many tables a flow derives from them."""
    from callgrid.functions.features import extract_from_files

    own, audio = _located(rows, data_root)
    made = extract_from_files(own, audio, name, cfg)
    about = rows.select("id", "label", "domain", "is_test")
    return stage(about.join(made.select("id", F.col("features").cast("array<double>").alias("features")), "id"), "features")


def classes_of(c: dict) -> tuple:
    return tuple(c.get("classes") or CLASSES)


def mapping_of(c: dict) -> dict | None:
    own = c.get("label_aggregation") or {}
    return dict(own.get("mapping") or FAMILIES) if own.get("enabled") else None


def train(manifest_path: str, config_path: str, data_root: str, out: str) -> dict[str, DataFrame]:
    """Fit, evaluate and write a submission; returns its tables."""
    c = settings(config_path)
    rows = manifest(manifest_path)
    leakage.require_no_leakage(rows)
    knn = pipelines.from_config(c)
    table = feature_table(events(rows, mapping_of(c)), data_root, knn.get("feature_set", "handcrafted_stats"), c["audio"])
    found = pipelines.submission(table, classes_of(c), knn, None if mapping_of(c) else FAMILIES)
    for name, t in found.items():
        t.write.mode("overwrite").parquet(f"{out}/{name}")
    texts = {"overview": pipelines.overview(found, knn.get("feature_set", "handcrafted_stats")), "domain_diagnostics": diagnostics.diagnostics_text(found)}
    if "ambiguities" in found:
        texts["ambiguity_report"] = diagnostics.ambiguity_text(found["ambiguities"], FAMILIES)
    for name, text in texts.items():
        table.sparkSession.createDataFrame([(text,)], "line string").coalesce(1).write.mode("overwrite").text(f"{out}/{name}")
    pipelines.save_model(table.where("NOT is_test"), classes_of(c), knn, f"{out}/model")
    return found


def predict(model: str, features: DataFrame) -> DataFrame:
    """Predictions of a saved classifier for (id, label, domain, features)."""
    rows, classes, knn = pipelines.load_model(features.sparkSession, model)
    return pipelines.predict(rows, features, classes, knn)


def evaluate(predictions_path: str, config_path: str, out: str) -> dict[str, DataFrame]:
    """All reports of stored predictions, written under ``out``."""
    c, p = settings(config_path), session().read.parquet(predictions_path)
    found = pipelines.evaluation(p, classes_of(c), None if mapping_of(c) else FAMILIES)
    for name, t in found.items():
        t.write.mode("overwrite").parquet(f"{out}/{name}")
    return found


def search(manifest_path: str, config_path: str, data_root: str, out: str, **how) -> str:
    """The staged search on the training split; results are written under ``out``."""
    c = settings(config_path)
    rows = manifest(manifest_path)
    leakage.require_no_leakage(rows)
    audits.require_selection_split(c.get("train_split", "train"), c.get("test_split", "validation"))
    own = events(rows.where(F.col("split") == c.get("train_split", "train")), mapping_of(c))
    return S.run_to(own, lambda r, name: feature_table(r, data_root, name, c["audio"]), classes_of(c), c, out, **how)


def baselines(manifest_path: str, config_path: str, data_root: str, out: str) -> dict[str, DataFrame]:
    from callgrid.functions.features import representation

    c = settings(config_path)
    own, rows = c.get("classical") or {}, events(manifest(manifest_path))
    if limit := own.get("limit_per_split"):
        rows = sampling.first_n(rows, ["split", "label"], ["dataset", "filename", "source_row"], int(limit))
    tables = {r: feature_table(rows, data_root, representation(r, own.get("img_size", 32)), c["audio"]) for r in own.get("representations", ["handcrafted",
        "patch", "hybrid"])}
    pca = own.get("pca") or {}
    parts = {r: (pca.get("components_by_family") or {}).get(r, pca.get("components")) for r in tables} if pca.get("enabled") else None
    found = B.compare(tables, classes_of(c), tuple(own.get("models") or B.models.MODELS), FAMILIES, parts, float(own.get("validation_fraction", 0.2)),
        int(c.get("seed", 42)))
    for name, t in found.items():
        t.write.mode("overwrite").parquet(f"{out}/{name}")
    return found


def clustering(manifest_path: str, config_path: str, data_root: str, out: str) -> dict[str, DataFrame]:
    from callgrid.functions.features import representation

    c = settings(config_path)
    own, split = c.get("clustering") or {}, c.get("test_split", "validation")
    rows = sampling.random_n(events(manifest(manifest_path)).where(F.col("split") == split), ["label"], "id", int(own.get("per_class_limit", 500)),
        int(c.get("seed", 42)))
    table = feature_table(rows, data_root, representation(own.get("representation", "handcrafted"), own.get("img_size", 32)), c["audio"])
    found = C.explore(table, len(classes_of(c)))
    for name, t in found.items():
        t.write.mode("overwrite").parquet(f"{out}/{name}")
    return found


def imbalance_audit(manifest_path: str, predictions_path: str, config_path: str, out: str) -> dict[str, DataFrame]:
    found = audits.imbalance_audit(manifest(manifest_path), session().read.parquet(predictions_path), classes_of(settings(config_path)))
    for name, t in found.items():
        t.write.mode("overwrite").parquet(f"{out}/{name}")
    return found


def notebook_evaluation(manifest_path: str, config_path: str, data_root: str, out: str) -> dict[str, DataFrame]:
    c = settings(config_path)
    rows = events(manifest(manifest_path), mapping_of(c))
    table = feature_table(rows.where(F.col("split") == c.get("train_split", "train")), data_root, (c.get("notebook") or {}).get("feature_set",
        "notebook_exact_44"), c["audio"])
    found = audits.notebook_evaluation(table, classes_of(c))
    for name, t in found.items():
        t.write.mode("overwrite").parquet(f"{out}/{name}")
    return found


def _located(rows: DataFrame, data_root: str) -> tuple[DataFrame, DataFrame]:
    """The rows with plain paths, and what their samples come from."""
    own = rows.withColumn("audio_path", F.regexp_replace("audio_path", "^file:/+", "/"))
    return own, wav.audio(own, data_root)


def audio_blocks(data_root: str, glob: str = "*.wav") -> DataFrame:
    """Samples of all files in blocks, for scans that need no events; filters on files and times are pushed down."""
    return wav.blocks(session(), data_root, glob)


def crop_verification(manifest_path: str, config_path: str, data_root: str, out: str, per_class: int = 3, size: int = 224) -> DataFrame:
    """Panels of the first events of each split and label, as files, with the table of their boxes."""
    rows = sampling.first_n(events(manifest(manifest_path)), ["split", "label"], ["dataset", "filename", "source_row"], per_class)
    made = images.crop_panels(*_located(rows, data_root), settings(config_path)["audio"], size)
    paths = images.export(made, f"{out}/panels")
    table = rows.select("id", "split", "label", "dataset", "filename", "source_row").join(made.drop("png"), "id").join(paths, "id")
    table.write.mode("overwrite").parquet(f"{out}/extents")
    return session().read.parquet(f"{out}/extents")


def inspect_errors(predictions_path: str, manifest_path: str, config_path: str, data_root: str, out: str, limit: int = 20) -> DataFrame:
    """The most confident errors with an image each."""
    from callgrid.operators.metrics import errors

    spark = session()
    predictions = spark.read.parquet(predictions_path)
    worst = errors(predictions).orderBy(F.desc("pred_confidence"), "id").limit(limit).select("id")
    rows = events(manifest(manifest_path)).join(worst, "id")
    panels = images.crop_panels(*_located(rows, data_root), settings(config_path)["audio"])
    return images.error_images(predictions, panels.select("id", "png"), out, limit)


def cache_summary(root: str) -> DataFrame:
    return sinks.cache_summary(session(), root)


def run_tests(path: str = "tests") -> None:
    """Run the tests in a process of their own; failures are an error."""
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-m", "pytest", path, "-q"], check=False)
    if done.returncode:
        raise RuntimeError(f"tests failed with code {done.returncode}")
