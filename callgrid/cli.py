"""Command line: python -m callgrid.cli COMMAND ..."""

from __future__ import annotations

import argparse

from callgrid import api
from callgrid.operators import leakage, profile, sampling
from callgrid.runtime import scratch
from callgrid.session import session
from callgrid.sources import annotations, images, sinks


def build(args) -> None:
    spark = session("build-manifest")
    manifest, issues = annotations.build_manifest(spark, args.data_root, args.splits, args.min_valid_seconds)
    manifest.write.mode("overwrite").parquet(args.out)
    issues.write.mode("overwrite").parquet(args.quality_report)
    rows, found = spark.read.parquet(args.out), spark.read.parquet(args.quality_report)
    sinks.report(profile.quality_summary(found), args.quality_summary)
    for name, columns in (("class_distribution", ("split", "label")), ("split_distribution", ("split",)), ("dataset_distribution", ("split", "dataset")),
        ("class_distribution_overall", ("label",))):
        sinks.report(profile.counts(rows, *columns), f"{args.split_distribution_dir}/{name}.csv")


def check(args) -> None:
    rows = api.manifest(args.manifest)
    sinks.report(leakage.leakage_counts(rows), args.out)
    leakage.require_no_leakage(rows)


def features(args) -> None:
    from callgrid.functions.features import feature_names

    cfg = api.settings(args.config)["audio"]
    table = api.feature_table(api.events(api.manifest(args.manifest)), args.data_root, args.feature_set, cfg)
    sinks.export_matrix(table, args.out, feature_names(args.feature_set), {"feature_set": args.feature_set, "audio": cfg})


def submission(args) -> None:
    if args.rebuild_manifest:
        api.build_manifest(args.data_root, args.manifest)
    api.train(args.manifest, args.config, args.data_root, args.output_dir)


def search(args) -> None:
    api.search(args.manifest, args.config, args.data_root, args.output_dir, quick_mode=args.quick, resume=args.resume, domain_aware=not args.cv_focused,
        wanted=args.stage, max_candidates=args.max_candidates or None)


def evaluate(args) -> None:
    api.evaluate(args.predictions, args.config, args.output_dir)


def baselines(args) -> None:
    api.baselines(args.manifest, args.config, args.data_root, args.output_dir)


def clustering(args) -> None:
    api.clustering(args.manifest, args.config, args.data_root, args.output_dir)


def notebook(args) -> None:
    api.notebook_evaluation(args.manifest, args.config, args.data_root, args.output_dir)


def representations(args) -> None:
    from callgrid.functions.features import export_representation

    rows = api.events(api.manifest(args.manifest)).where(api.F.col("split").isin(*args.splits))
    rows = rows.orderBy("split", "dataset", "filename", "source_row").limit(args.limit) if args.limit else rows
    export_representation(*api._located(rows, args.data_root), args.family, api.settings(args.config)["audio"], args.out, args.img_size,
        args.pca_components or None)


def spectrograms(args) -> None:
    rows = api.events(api.manifest(args.manifest)).where(api.F.col("split").isin(*args.splits))
    if args.max_per_class_per_split:
        rows = sampling.first_n(rows, ["split", "label"], ["dataset", "filename", "source_row"], args.max_per_class_per_split)
    panels = images.crop_panels(*api._located(rows, args.data_root), api.settings(args.config)["audio"], args.img_size)
    rows.join(images.export(panels, f"{args.out}/images"), "id").write.mode("overwrite").parquet(f"{args.out}/manifest")


def crops(args) -> None:
    api.crop_verification(args.manifest, args.config, args.data_root, args.out, args.per_class, args.img_size)


def audit(args) -> None:
    api.imbalance_audit(args.manifest, args.predictions, args.config, args.out)


def errors(args) -> None:
    api.inspect_errors(args.predictions, args.manifest, args.config, args.data_root, args.out, args.limit)


def regenerate(args) -> None:
    """The manifest, its reports, the leakage check and the record of the run, in one session."""
    args.out, args.split_distribution_dir = args.manifest, f"{args.reports_root}/manifest"
    args.quality_report, args.quality_summary = f"{args.reports_root}/quality/issues", f"{args.reports_root}/quality/data_quality_summary.csv"
    build(args)
    spark = session()
    rows = spark.read.parquet(args.manifest)
    sinks.report(leakage.leakage_counts(rows), f"{args.reports_root}/quality/split_integrity.csv")
    counts = {"manifest": rows.count(), "issues": spark.read.parquet(args.quality_report).count()}
    sinks.write_json(sinks.provenance(counts, [args.quality_summary], ["regenerate"]), f"{args.reports_root}/provenance.json")


def cache(args) -> None:
    spark = session("cache")
    if args.clear or args.clear_except_current:
        sinks.clear_cache(spark, args.root, args.clear_except_current)
    else:
        print(sinks.markdown(sinks.cache_summary(spark, args.root)))


def main(argv=None) -> None:
    top = argparse.ArgumentParser(prog="callgrid")
    sub = top.add_subparsers(required=True)

    def command(name, run, *flags, **defaults):
        p = sub.add_parser(name)
        for f in flags:
            p.add_argument(f"--{f}", required=True)
        for f, v in defaults.items():
            p.add_argument(f"--{f.replace('_', '-')}", **({"action": "store_true"} if v is False else {"nargs": "+", "default": v} if isinstance(v, list)
                else {"default": v, "type": type(v)}))
        p.set_defaults(run=run)

    both, three = ["train", "validation"], ("manifest", "config", "data-root")
    command("build-manifest", build, "data-root", "out", quality_report="quality_issues", quality_summary="quality_summary.csv",
        split_distribution_dir="reports", min_valid_seconds=0.5, splits=both)
    command("check-splits", check, "manifest", out="split_integrity.csv")
    command("features", features, *three, "out", feature_set="handcrafted_stats")
    command("submission", submission, *three, "output-dir", rebuild_manifest=False)
    command("search", search, *three, "output-dir", quick=False, resume=False, cv_focused=False, stage="full", max_candidates=0)
    command("evaluate", evaluate, "predictions", "config", "output-dir")
    command("baselines", baselines, *three, "output-dir")
    command("clustering", clustering, *three, "output-dir")
    command("notebook", notebook, *three, "output-dir")
    command("representations", representations, *three, "out", family="patch", img_size=32, pca_components=0, limit=0, splits=both)
    command("spectrograms", spectrograms, *three, "out", img_size=224, max_per_class_per_split=0, splits=both)
    command("verify-crops", crops, *three, "out", per_class=3, img_size=224)
    command("audit", audit, "manifest", "config", "predictions", "out")
    command("inspect-errors", errors, *three, "predictions", "out", limit=20)
    command("regenerate", regenerate, "data-root", "manifest", "reports-root", min_valid_seconds=0.5, splits=both)
    command("cache", cache, "root", summary=False, clear=False, clear_except_current=False)
    args = top.parse_args(argv)
    with scratch(session()):
        args.run(args)


if __name__ == "__main__":
    main()
