"""A query that reads its neighbours twice searches once."""

import re

from conftest import TESTDATA

from callgrid.plans import report_queries  # noqa: F401
from callgrid.plans.queries import QUERIES


def test_distance_stats(spark, capsys):
    QUERIES["q101_neighbor_distance_stats"](spark, TESTDATA).explain()
    assert "FlatMapCoGroups" not in capsys.readouterr().out  # before, the search stood in the plan of the report and of the votes


def test_folds_share_the_tasks(spark, monkeypatch):
    """Seven folds of few rows; before, each of them was cut into as many blocks as one table is."""
    from callgrid.operators import knn

    monkeypatch.setattr(knn, "LEAST", 1)
    rows = spark.range(700).selectExpr("id", "CAST(id % 7 AS INT) AS fold", "array(CAST(id * 37 % 101 AS DOUBLE), CAST(id % 13 AS DOUBLE)) AS features")
    near = knn.neighbours(rows, rows, 2, by="fold", exclude_self=True)
    assert near.count() == 1400
    plan = near._jdf.queryExecution().toString()
    assert max(int(n) for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", plan)) <= 2 * 200


def test_copies_of_a_row(spark, monkeypatch):
    """Three folds of any size; before, a row had 19 copies: as train row of two folds one for each of 5 blocks of queries, as
    query one for each of 9 blocks of train rows."""
    from callgrid.operators import knn

    for rows in (100_000, 615_384):
        n_t, n_q = knn._blocks(rows * 2 // 3, rows // 3, 48 / 3)
        assert 2 * n_q + n_t <= 12 and 3 * n_t * n_q >= 36
    assert knn._blocks(10**7, 10**7, 48)[0] == -(-(10**7) // knn.BLOCK)  # a block's memory has its bound
    assert knn._blocks(10**6, 10, 48)[1] == knn._blocks(0, 0, 48)[0] == 1
    monkeypatch.setattr(knn, "LEAST", 100)
    rows = spark.range(3000).selectExpr("id", "CAST(id % 3 AS INT) AS fold", "array(CAST(id * 37 % 1009 AS DOUBLE), CAST(id % 13 AS DOUBLE)) AS features")
    train = rows.selectExpr("id", "features", "explode(filter(array(0, 1, 2), f -> f <> fold)) AS fold")
    near = knn.neighbours(train, rows, 3, by="fold")
    sent = [int(n) for n in re.findall(r"sequence\(0, (\d+)", near._jdf.queryExecution().analyzed().toString())]
    got = {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in near.collect()}
    whole = knn.neighbours(train, rows, 3, by="fold", block=10**6).collect()
    assert len(sent) == 2 and 2 * (min(sent) + 1) + max(sent) + 1 <= 12
    assert len(got) == 9000 and got == {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in whole}
