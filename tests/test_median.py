"""The profile of a column: its median by counts of ranges, as Spark's own on odd values."""

from pyspark.sql import functions as F

from tessera.operators.telemetry import exact_median, profile

NAN = float("nan")


def test_median_as_percentile(spark):
    for values in ([], [None], [3.0], [1.0, 2.0], [0.0, -0.0, 5.0], [1.0, 1.0, 9.0, None, 4.0], [NAN, 1.0], [NAN, NAN, 1.0], [float(i * 7919 % 1000) for i in range(1001)], [float(i // 3) for i in range(1000)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        want, got = df.agg(F.percentile("v", 0.5)).first()[0], exact_median(df, "v").first()[0]
        assert got == want or got != got and want != want, values
        assert profile(df, "v").count() == 1


def test_no_list_of_all_values(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert "percentile" not in profile(df, "v")._jdf.queryExecution().analyzed().toString()
