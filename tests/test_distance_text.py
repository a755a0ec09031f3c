"""Distances as texts: eight significant digits, and at most seven decimals as the SQL of q141 prints them."""

from pyspark.sql import functions as F

from callgrid.operators import knn


def test_distances_below_one(spark):
    values = [0.54336443, 0.74251405, 0.54336445, 0.00390625, 0.0123456789, 6.2951756, 12.345679, 100.0, 1234567.5]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", knn.distance_text(F.col("v"), 7).alias("t"),
        knn.distance_text(F.col("v")).alias("whole")).collect()
    assert [r["t"] for r in got] == [f"{float(f'{r['v']:.8g}'):.7f}".rstrip("0").rstrip(".") for r in got]
    assert [r["whole"] for r in got[:3]] == ["0.54336443", "0.74251405", "0.54336445"]


def test_query_with_near_copies(spark, tmp_path):
    """Copies that differ in one component are nearer than 1, which the table of the other tests has none of."""
    from callgrid.plans import report_queries  # noqa: F401
    from callgrid.plans.queries import ORACLES, QUERIES

    rows = [(i, i % 10, [((i // 2 * 37 + j * 11) % 101) / 101 + (i % 2) * (j == 3) * 0.01234567 * (i + 1) for j in range(8)]) for i in range(60)]
    t = spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>")
    t.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(con.sql(ORACLES["q141_neighbour_distances"]).fetchall())
    got = {r[0]: r[1] for r in QUERIES["q141_neighbour_distances"](spark, str(tmp_path)).collect()}
    assert got == want and any(t.startswith("0.") for t in want.values())
