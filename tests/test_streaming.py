import datetime as dt
import time
import uuid

from pyspark.sql import functions as F

from barloom.streaming.bars import stream_bars, stream_ema, stream_sessions

T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, rows, schema, build):
    src, name = str(tmp_path / uuid.uuid4().hex), "q" + uuid.uuid4().hex
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)  # files are read in the order of their times
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_bars_and_late_rows(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    first = [("a", at(1), 5.0, 1), ("a", at(40), 7.0, 2), ("a", at(59), 6.0, 3), ("a", at(61), 8.0, 4), (None, at(2), 1.0, 9), ("a", at(3), None, 9)]
    second = [("b", at(240), 1.0, 5)]
    more = [("b", at(300), 1.0, 8)]  # a batch drops what was late when the batch before began
    third = [("a", at(5), 99.0, 6), ("b", at(500), 1.0, 7)]
    got = run(spark, tmp_path, [first, second, more, third], "k string, t timestamp, v double, n int", lambda s: stream_bars(s, symbol="k", ts="t", value="v", order=["t", "n"]))
    assert ("a", T0, 5.0, 7.0, 5.0, 6.0, 3.0) in got and ("a", at(60), 8.0, 8.0, 8.0, 8.0, 1.0) in got


def test_sessions(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    got = run(spark, tmp_path, [[("u", at(0)), ("u", at(10)), ("u", at(100))], [("u", at(900))], [("u", at(2000))]], "k string, t timestamp", lambda s: stream_sessions(s, key="k", ts="t"))
    assert ("u", at(0), at(40), 2) in got


def test_ema_equals_batch(spark, tmp_path):
    from barloom.operators.indicators import compute

    rows = [("a", T0 + dt.timedelta(days=i), float((i * 7) % 11)) for i in range(30)]
    got = run(spark, tmp_path, [rows[:10], rows[10:]], "symbol string, ts timestamp, close double", lambda s: stream_ema(s, 5))
    batch = compute(spark.createDataFrame(rows, "symbol string, ts timestamp, close double"), "EMA", {"window": 5})
    want = {r.ts: r.ema for r in batch.select("ts", F.round("ema", 9).alias("ema")).collect()}
    assert {t: e if e is None else round(e, 9) for _, t, e in got} == want
