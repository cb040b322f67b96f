import os

import pytest
from pyspark.sql import functions as F

from millrace import streaming
from millrace.plans import naming, staging
from millrace.plans.checkpoints import Checkpoints, Policy
from millrace.plans.metrics import Metrics
from millrace.testing import Builder, KeyedBuilder, assert_any, assert_contains, assert_grouped, assert_map, assert_none, debug, numbers_with_outliers, pseudo_random, pseudo_random_pairs, sequential_pairs, skewed_pairs, time_series


def test_cut_reads_from_the_shared_folder(spark):
    df = staging.cut(spark.range(10))
    assert df.count() == 10
    assert staging.shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert "ParquetScan" in naming.explain(df) or "Scan parquet" in naming.explain(df)
    staging.discard(df)


def test_names_and_plans(spark):
    with naming.named_scope(spark, "a"), naming.named_scope(spark, "b") as full:
        assert full == "a/b"
        df = naming.with_name(spark.range(1), "step")
    assert "a/b/step" in naming.names()
    assert "Range" in naming.snapshot(df)["physical"]


def test_metrics(spark, tmp_path):
    m = Metrics()
    m.start()
    df = m.histogram(m.observe(spark.range(100), rows=F.count(F.lit(1))), "h", "id")
    df.write.format("noop").mode("overwrite").save()
    m.count("c", 2)
    m.count("c")
    m.gauge("g", 1.5)
    m.stop()
    got = m.collect()
    assert got["rows"] == 100 and got["h.max"] == 99 and got["c"] == 3 and got["g"] == 1.5 and got["elapsed_s"] > 0
    m.save(tmp_path / "m.json")
    assert "h.p95" in (tmp_path / "m.json").read_text()


def test_checkpoints_restore_data(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(5)

    root = f"file://{tmp_path}"
    for _ in range(2):
        c = Checkpoints(spark, "job", root=root)
        assert c.step("one", make).count() == 5
    assert len(made) == 1 and c.log == [("one", "restored")]
    assert c.step("one", make, version="2").count() == 5 and len(made) == 2
    off = Checkpoints(spark, "other", Policy(every=None), root)
    off.step("x", make)
    assert off.log == [("x", "made")]
    few = Checkpoints(spark, "few", Policy(keep=2), root)
    for i in range(4):
        few.step(str(i), make)
    assert len([d for d in os.listdir(tmp_path / "checkpoints-few") if not d.startswith(".")]) == 2
    few.clear()


def test_testing_helpers(spark):
    df = Builder().add(1, 2).repeat(3, 2).span(5, 7).frame(spark, "v int")
    assert df.count() == 6
    assert_any(df, F.col("v") == 6)
    assert_none(df, F.col("v") > 6)
    assert_contains(df, (5,))
    kv = KeyedBuilder().add_key("a", 1, 2).frame(spark, "k string, v int")
    assert_grouped(kv.groupBy("k").agg(F.collect_list("v")), {"a": [2, 1]})
    assert_map(kv.groupBy("k").count(), {"a": 2})
    with pytest.raises(AssertionError):
        assert_none(df, F.col("v") == 1)
    said = []
    debug(df, "x", 1, said.append)
    assert said[0].startswith("x: 6 rows")
    assert sum(k == "hot" for k, _ in skewed_pairs(100)) == 50 and len(sequential_pairs(5, 2)) == 5
    assert pseudo_random(3) == pseudo_random(3) and len(pseudo_random_pairs(4, 2)) == 4
    assert 150.0 in numbers_with_outliers() and time_series()[0] == (1000, 0.0)


def test_stream_windows(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 7), (9_000, 1)], "s bigint, v bigint").select(F.timestamp_seconds("s").alias("ts"), "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, v bigint").parquet(str(tmp_path / "in"))
    q = streaming.combine_per_window(stream, "ts", "1 minute", "1 minute", total=F.sum("v")).writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["total"] for r in spark.table("closed").collect()] == [12]


def test_session_helpers(spark):
    from millrace.plans import session

    assert session.partitions_for(0, 8) == 8 and session.partitions_for(10 << 30, 8) == 80
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert session.tune(spark.range(10), 3) == 3
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert session.coders(spark.range(1)) == {"id": "bigint"}
    assert "spark.local.dir" in session.Memory(local_dirs="/x").settings()
