"""The streaming builders over real streams give what they give over tables."""

import datetime as dt

from pyspark.sql import functions as F

from slate.streaming import windows as Z


def events(spark, folder):
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, start + dt.timedelta(minutes=7 * k), k % 5, float(k)) for k in range(200)]
    table = spark.createDataFrame([*rows, *rows[:10]], "user long, ts timestamp, kind long, v double")
    table.repartition(4).write.parquet(folder)
    return spark.read.parquet(folder), spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finished(spark, df, name, mode):
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()), key=str)


def test_streams(spark, tmp_path):
    table, stream = events(spark, str(tmp_path / "events"))
    aggs = {"n": F.count(F.lit(1)), "total": F.sum("v")}
    for name, build in {"windows": lambda d: Z.windowed(d, "ts", "1 hour", aggs, ["kind"], late="2 days"), "sliding": lambda d: Z.windowed(d, "ts", "1 hour", aggs, slide="30 minutes", late="2 days"), "gaps": lambda d: Z.sessions(d, "ts", "25 minutes", aggs, ["user"], late="2 days")}.items():
        assert finished(spark, build(stream), name, "complete") == sorted(map(tuple, build(table).collect()), key=str)
    keys = ["user", "ts"]
    once = finished(spark, Z.distinct_within(stream, keys, "ts", "30 days").select(*keys), "once", "append")
    assert once == sorted(map(tuple, Z.distinct_within(table, keys, "ts", "30 days").select(*keys).collect()), key=str) and len(once) == 200
