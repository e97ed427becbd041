"""Stateful streams against their batch forms on a replay in several batches, with a stop and a new start between them."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stations
from tidemark.streaming import stateful

T0 = datetime(2024, 1, 1)
SCHEMA = "user int, ts timestamp, id int, lat double, lon double, ok boolean"


def fixes(n=240):
    r = random.Random(7)
    rows = [(r.randint(0, 3), T0 + timedelta(seconds=i * 2), i, 44 + r.random() / 100, -86 + r.random() / 100, r.random() < 0.8) for i in range(n)]
    return [rows[i : i + n // 4] for i in range(0, n, n // 4)]


def replayed(spark, tmp_path, make, parts, schema, mode):
    """Two queries, one after the other, on one checkpoint: the second sees the files that came after the first had stopped."""
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    number = 0
    for half in (parts[:2], parts[2:]):
        for p in half:
            spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(folder)
        with stateful.state_store(spark):
            rows = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
            q = rows.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/n={n}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
            number += 1
    return spark.read.parquet(f"{out}/n=*")


@pytest.mark.parametrize(("seconds", "least", "ok"), [(5, 0.2, None), (30, None, "ok")])
def test_throttled_as_its_batch_form(spark, tmp_path, seconds, least, ok):
    parts = fixes()
    got = replayed(spark, tmp_path, lambda s: stateful.throttled(s, ["user"], "ts", seconds, least, ok), parts, SCHEMA, "append")
    want = stations.throttled(spark.createDataFrame([x for p in parts for x in p], SCHEMA), ["user"], "ts", seconds, least, ok)
    rows = lambda df: sorted((x.user, x.id, x.taken) for x in df.collect())
    assert rows(got) == rows(want) and 0 < want.where("taken").count() < 240


def test_histories_of_runs(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("ab"), date(2024, 1, 1 + i // 30), r.randint(0, 3), T0 + timedelta(minutes=i)) for i in range(120)] + [("a", date(2024, 1, 1), 9, T0 + timedelta(days=9))]
    parts = [rows[i : i + 31] for i in range(0, 121, 31)]
    schema = "home string, target_date date, slot int, at timestamp"
    out = replayed(spark, tmp_path, lambda s: stateful.run_histories(s, ["home"], "at"), parts, schema, "update").collect()
    for home in "ab":
        own = [x for x in rows if x[0] == home]
        day = max(x[1] for x in own)
        want = {x[2]: x[3] for x in own if x[1] == day}
        last = max(x.batch for x in out if x.home == home)
        got = {x.slot: T0 + timedelta(microseconds=x.at_us - int(T0.timestamp() * 1e6)) for x in out if x.home == home and x.batch == last}
        assert got == want and {x.target_date for x in out if x.home == home and x.batch == last} == {day}


def test_the_query_as_its_batch_form(spark):
    from tidemark.plans import services

    sf = "/root/testdata/sf0.001"
    rows = lambda df: sorted((r.event_id, r.taken) for r in df.collect())
    assert rows(services.ttl_stream(spark, sf)) == rows(services.ttl_requests(spark, sf))
