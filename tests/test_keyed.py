from brindle.operators.keyed import heavy_keys, per_key


def rows(spark):
    data = [(1, 10, 2.0), (1, 10, 2.0), (1, 11, 3.0), (2, 12, None), (None, 13, 5.0), (None, None, 1.0), (3, None, 4.0)]
    return spark.createDataFrame(data, "u int, id int, v double")


def test_per_key(spark):
    got = {r["u"]: tuple(r)[1:] for r in per_key(rows(spark), "u", "id", "v").collect()}
    assert got == {1: (3, 2, 7.0, 5.0), 2: (1, 1, None, None), None: (2, 1, 6.0, 5.0), 3: (1, 0, 4.0, None)}


def test_plain_and_names(spark):
    df = rows(spark).withColumnRenamed("u", "n_rows")
    out = per_key(df, "n_rows")
    assert out.columns == ["n_rows", "n_rows_"]
    assert {tuple(r) for r in out.collect()} == {(1, 3), (2, 1), (None, 2), (3, 1)}
    assert per_key(df.where("false"), "n_rows", "id", "v").collect() == []


def test_heavy(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 333 THEN 7 WHEN id < 353 THEN 8 WHEN id < 372 THEN 9 WHEN id < 600 THEN NULL ELSE id END AS u")
    assert {tuple(r) for r in heavy_keys(df, "u", 50).collect()} == {(7, 333), (8, 20)}
    assert heavy_keys(df.where("false"), "u", 50).collect() == []


def test_combined_before_the_shuffle(spark):
    plan = per_key(rows(spark), "u")._jdf.queryExecution().toString()
    assert "partial_count" in plan
