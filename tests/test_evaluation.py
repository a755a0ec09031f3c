"""All reports of a table of stored predictions."""

import json
import os

import numpy as np
import pytest

from callgrid import api, cli
from callgrid.plans import search

CLASSES = ("a", "b", "c")


def test_reports_of_stored_predictions(spark, tmp_path):
    r = np.random.default_rng(2)
    p = np.round(r.dirichlet([1, 1, 1], 90), 2)  # scores repeat
    true = [CLASSES[v] for v in r.integers(0, 2, 90)]  # no row is c
    rows = [(i, f"d{i % 2}", true[i], CLASSES[int(v.argmax())], {c: float(x) for c, x in zip(CLASSES, v, strict=True)}, float(v.max()),
        float(v[CLASSES.index(true[i])])) for i, v in enumerate(p)]
    spark.createDataFrame(rows, "id long, dataset string, y_true_label string, y_pred_label string, probs map<string,double>, pred_confidence double, "
        "true_probability double").withColumn("label", api.F.lit("clash")).write.parquet(f"{tmp_path}/p")
    (tmp_path / "c.yaml").write_text(json.dumps({"classes": list(CLASSES), "audio": {"sample_rate": 250}}))
    cli.main(["evaluate", "--predictions", f"{tmp_path}/p", "--config", str(tmp_path / "c.yaml"), "--output-dir", f"file://{tmp_path}/out"])
    found = os.listdir(tmp_path / "out")
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert {"summary", "pr_curves", "confidence", "by_domain", "permutation", "family_summary"} <= set(found)
    hits = np.array([x[2] == x[3] for x in rows])
    assert abs(read("summary").first()["accuracy"] - hits.mean()) < 1e-12
    assert {x["label"]: x["support"] for x in read("confidence").collect()} == {c: true.count(c) for c in CLASSES}
    middle = {x["label"]: x["median_true_probability"] for x in read("confidence").collect()}
    assert all(abs(middle[c] - np.median([x[6] for x in rows if x[2] == c])) < 1e-12 for c in "ab")
    got = {(x["label"], x["score"]): (x["precision"], x["recall"]) for x in read("pr_curves").collect()}
    for k, c in enumerate(CLASSES):
        own = np.array([t == c for t in true])
        for s in np.unique(p[:, k]):
            above = p[:, k] >= s
            want = own[above].mean(), own[above].sum() / own.sum() if own.any() else 0.0
            assert np.allclose([v or 0.0 for v in got[c, float(s)]], want)
    assert len(got) == sum(len(np.unique(p[:, k])) for k in range(3))
    assert {x["label"] for x in read("average_precision").collect()} == set(CLASSES)


@pytest.mark.parametrize(("flags", "own", "want"), [([], None, None), ([], 7, 7), (["--max-candidates", "3"], None, 3), (["--max-candidates", "3"], 2, 2)])
def test_candidate_limit_reaches_the_search(spark, tmp_path, monkeypatch, flags, own, want):
    class Stop(Exception):
        pass

    def run(rows, features, classes, settings, *rest):
        assert settings.get("max_candidates") == want
        raise Stop

    monkeypatch.setattr(search, "run", run)
    config = {"classes": list(CLASSES), "audio": {"sample_rate": 250}, "search": {} if own is None else {"max_candidates": own}}
    monkeypatch.setattr(api, "search", lambda m, c, root, out, **how: search.run_to(spark.range(1), None, CLASSES, config, out, how.pop("quick_mode"), **how))
    with pytest.raises(Stop):
        cli.main(["search", "--manifest", "m", "--config", "c", "--data-root", "d", "--output-dir", str(tmp_path), *flags])
