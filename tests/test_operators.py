import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import combiners as C
from millrace.functions import bloom, text, validation
from millrace.operators import batches, filters, joins, keyed, outputs, sampling, sets, transforms, windows
from millrace.plans import barriers
from millrace.testing import assert_all, assert_empty, assert_equal, assert_same, assert_size, rows


@pytest.fixture(scope="module")
def pairs(spark):
    return transforms.from_rows(spark, [("a", 1), ("a", 2), ("b", None), (None, 4), (None, 5), ("c", 3)], "key string, value int")


def test_filters_treat_null_as_a_value(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    assert_size(filters.filter_ne(df, "x", 1.0), 3)
    assert_same(filters.filter_gt(df, "x", 0.0), [(1.0,), (3.0,)])
    assert_same(filters.filter_eq(df, "x", None), [(None,)])
    assert_same(filters.filter_range(df, "x", 1.0, 3.0), [(1.0,)])
    assert_same(filters.filter_range_inclusive(df, "x", 1.0, 3.0), [(1.0,), (3.0,)])


def test_filter_sees_the_mapped_value(pairs):
    done = filters.filter_values(transforms.map_values(pairs, F.col("value") * 10), "value > 25")
    assert sorted(r["value"] for r in done.collect()) == [30, 40, 50]


def test_null_keys_group_and_join(spark, pairs):
    assert_same(keyed.count_per_key(pairs, "key"), [("a", 2), ("b", 1), (None, 2), ("c", 1)])
    right = spark.createDataFrame([(None, "x"), ("a", "y"), ("z", "w")], "key string, name string")
    assert_size(joins.join_inner(pairs, right, "key"), 4)
    assert_size(joins.join_left(pairs, right, "key"), 6)
    assert_same(joins.join_right(pairs, right, "key").where("name = 'w'"), [("z", None, "w")])
    full = joins.join_full(pairs, right, "key")
    assert_size(full, 7)
    assert {r["key"] for r in full.collect()} == {"a", "b", "c", "z", None}
    with pytest.raises(ValueError, match="rename"):
        joins.join(pairs, pairs, "key")


def test_products_of_large_keys_are_dealt_over_the_tasks(spark):
    keys = "CASE WHEN id < {0} THEN NULL WHEN id < {0} + 900 THEN -1L WHEN id % 2 = {1} THEN id + {2} ELSE id END"
    left = spark.range(4000).selectExpr("id AS a", keys.format(1500, 0, 10_000) + " AS key").unionByName(spark.range(1000).selectExpr("7 AS a", "-2L AS key"))
    right = spark.range(3000).selectExpr("id AS b", keys.format(700, 1, 20_000) + " AS key").unionByName(spark.range(1000).selectExpr("8 AS b", "-2L AS key"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    seen = ["key", "count(1)", "count(a)", "count(b)", "sum(a)", "sum(b)"]
    count = lambda df: sorted(map(tuple, df.groupBy("key").agg(*map(F.expr, seen[1:])).collect()), key=repr)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("inner", "left", "right", "full"):
            got = joins.join(left, right, "key", how)
            assert got.columns == ["key", "a", "b"]
            assert count(got) == count(joins.join(left, right, "key", how, deal=False)), how
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        made = joins.join_full(left, right, "key").where("key IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in made) == 1500 * 700 and len(made) > 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_right_join_deals_the_product_of_nulls_over_the_tasks(spark):
    left, right = (spark.range(2000).selectExpr(f"id AS {c}", "IF(id < 1200, NULL, id) AS key") for c in "ab")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or so few bytes come to one task
    try:
        made = joins.join_right(left, right, "key").where("key IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in made) == 1200 * 1200 and len(made) > 1


def test_cogroup_keeps_all_keys_and_null_values(spark, pairs):
    other = spark.createDataFrame([("a", "p"), ("q", None)], "key string, name string")
    got = {r["key"]: (len(r["left"]), len(r["right"])) for r in joins.cogroup("key", left=pairs, right=other).collect()}
    assert got == {"a": (2, 1), "b": (1, 0), None: (2, 0), "c": (1, 0), "q": (0, 1)}


def test_side_inputs(spark, pairs):
    other = spark.createDataFrame([("a", 1, 1), ("a", 9, 2), ("b", 7, 1)], "key string, n int, at int")
    assert_same(joins.side_map(other.select("key", "n", "at"), "key", "at").select("key", "n"), [("a", 9), ("b", 7)])
    assert_size(joins.filter_with_side(pairs, other, "key"), 3)
    assert_size(joins.filter_with_side(pairs, other, "key", present=False), 3)
    many = joins.map_with_side_multimap(pairs, other, "key", "found")
    assert sorted(len(r["found"]) for r in many.collect()) == [0, 0, 0, 1, 2, 2]
    assert_size(joins.filter_with_side_multimap(pairs, other, "key", lambda v: F.size(v) > 1), 2)
    with pytest.raises(ValueError):
        joins.side_singleton(other, "n")


def test_aggregates_of_nothing(spark):
    none = spark.createDataFrame([], "key string, value double")
    got = keyed.combine_globally(none, s=C.total("value"), a=C.average("value"), m=C.least("value"), q=C.approx_median("value"), l=C.to_list("value"), n=C.count()).first()
    assert (got["s"], got["a"], got["m"], got["l"], got["n"]) == (0, 0, None, [], 0)
    assert got["q"] != got["q"]
    assert_empty(keyed.sum_per_key(none, "key", "value"))
    assert keyed.kmv_distinct(none, "key").first()[0] == 0
    assert C.python_combiner(none, [], "value", int, lambda a, x: a + 1, lambda a, b: a + b, int, "n bigint").collect()[0][0] == 0


def test_lists_keep_nulls_and_order(pairs):
    got = keyed.to_list_per_key(pairs, "key", "value", order_by=["value"])
    assert_same(got, [("a", [1, 2]), ("b", [None]), (None, [4, 5]), ("c", [3])])
    assert keyed.distinct_count_globally(pairs, "value").first()[0] == 6
    assert rows(keyed.to_set_globally(pairs, "value"))[0][0] == (None, 1, 2, 3, 4, 5)


def test_latest_takes_the_first_of_equal_times(spark):
    df = spark.createDataFrame([("k", 5, "x", 1), ("k", 5, "y", 2), ("k", 1, "z", 3)], "key string, ts int, v string, seq int")
    assert_equal(keyed.latest_per_key(df, "key", "v", "ts", "seq"), [("k", "x")])


def test_to_dict_last_value_wins(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), (None, 3, 3)], "k string, v int, seq int")
    assert keyed.to_dict(df, "k", "v", "seq").first()[0] == {"a": 2}


def test_quantiles_skip_nan_and_clamp(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 101)] + [(float("nan"),), (float("inf"),)], "x double")
    got = keyed.approx_quantiles_globally(df, "x", [-1, 0.5, 2]).first()[0]
    assert got[0] == 1 and got[2] == 100 and abs(got[1] - 50) <= 1
    assert keyed.combine_globally(df, c=C.cdf("x", 25.0)).first()[0] == 0.25
    with pytest.raises(ValueError):
        C.approx_distinct("x", 1.5)


def test_kmv_is_near_and_exact_when_small(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 3).alias("key"))
    assert abs(keyed.kmv_distinct(df, "id", 256).first()[0] - 20_000) < 4_000
    assert keyed.kmv_distinct(df, "key", 256).first()[0] == 3
    assert all(abs(r["distinct"] - 6_667) < 1_500 for r in keyed.kmv_distinct(df, "id", 256, "key").collect())


def test_python_combiner_per_key(pairs):
    got = C.python_combiner(pairs.where("value is not null"), ["key"], "value", list, lambda a, x: [*a, int(x)], lambda a, b: a + b, lambda a: max(a) - min(a), "spread bigint")
    assert_same(got, [("a", 1), (None, 1), ("c", 0)])


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(parts=st.integers(1, 7))
def test_samples_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 5).alias("key"))
    assert sorted(rows(sampling.sample_rows(df.repartition(parts), 20, 3))) == sorted(rows(sampling.sample_rows(df, 20, 3)))
    again = sampling.sample_list_per_key(df.repartition(parts), "key", 4)
    assert sorted(rows(again)) == sorted(rows(sampling.sample_list_per_key(df, "key", 4)))
    assert len(sampling.sample_list(df, 1000).first()[0]) == 500


def test_top_k_keeps_repeats(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("b", 2)], "key string, v int")
    assert sets.top_k_globally(df, "v", 2).first()[0] == [3, 3]
    assert sets.bottom_k_globally(df, "v", 2).first()[0] == [1, 2]
    assert_size(sets.top_k_per_key(df, "key", "v", 2), 3)
    assert keyed.combine_per_key(df, "key", t=C.top_k("v", 2), b=C.bottom_k("v", 1)).where("key = 'a'").first()[1:] == ([3, 3], [1])
    with pytest.raises(ValueError):
        sets.flatten()


def test_windows_before_the_offset_floor(spark):
    df = spark.createDataFrame([(-1,), (0,), (99,), (100,)], "ms bigint").select(F.timestamp_millis("ms").alias("ts"), F.col("ms").alias("v"))
    got = sorted(rows(windows.count_per_window(df, "ts", 100, 30)))
    assert got == [(-70, 30, 2), (30, 130, 2)]
    assert sorted(r["window_start"] for r in windows.sum_per_window(df, "ts", "v", 100).collect()) == [-100, 0, 100]
    with pytest.raises(ValueError):
        windows.tumble(F.lit(1), 0)


def test_batches(spark):
    df = spark.range(103).repartition(3)
    done = batches.batch_elements(df, 10)
    assert sum(len(r[0]) for r in done.collect()) == 103
    assert max(len(r[0]) for r in done.collect()) <= 10
    ordered = sorted(batches.batch_ordered(df, 25, ["id"]).collect())
    assert [[x["id"] for x in r["batch"]] for r in ordered] == [list(range(a, min(a + 25, 103))) for a in range(0, 103, 25)]
    sized = batches.batch_by_size(spark.range(5).coalesce(1), 10, F.when(F.col("id") == 2, 50).otherwise(4)).collect()
    assert [len(r[0]) for r in sized] == [2, 1, 2]
    with pytest.raises(ValueError):
        batches.group_into_batches(df, "id", 0, ["id"])
    with pytest.raises(Exception, match="returned"):
        batches.map_values_batches(df, 10, lambda s: list(s)[1:], "id", "bigint").collect()


def test_text(spark):
    df = spark.createDataFrame([("a1",), ("b",), (None,), ("",)], "s string")
    assert_same(text.extract(df, "s", "([a-z])([0-9])?", 2), [("1",)])
    assert_same(text.extract(df, "s", "([a-z]*)", 1), [("a",), ("b",), ("",)])
    assert_same(text.find(df, "s", "[0-9]"), [("1",)])
    assert_same(text.split(spark.createDataFrame([("a,,b,",)], "s string"), "s", ","), [("a",), ("",), ("b",), ("",)])
    assert_same(text.extract(spark.createDataFrame([("xb",), ("ya",)], "s string"), "s", "x(b)|y(a)", 1), [("b",)])
    for pattern in ("(?=a)", "(?<!a)b", r"(a)\1"):
        with pytest.raises(ValueError):
            text.checked(pattern)


def test_validation_modes(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (2, "bad"), (3, None)], "id int, mail string")
    rules = [validation.is_email("mail"), validation.in_range("id", 1, 2)]
    good, errors = validation.validate(df, rules, "log", "id")
    assert_same(good, [(1, "a@b.c")])
    assert {r["record_id"]: len(r["errors"]) for r in errors.collect()} == {"2": 1, "3": 2}
    assert_empty(validation.validate(df, rules, "skip")[1])
    with pytest.raises(Exception, match="invalid row"):
        validation.fail_fast(df, rules).collect()
    assert_size(validation.fail_fast(df.where("id = 1"), rules), 1)
    assert validation.with_errors(spark.createDataFrame([("é",)], "s string"), [validation.min_length("s", 2), validation.max_length("s", 1)]).first()["errors"][0]["code"] == "MAX_LENGTH"


def test_errors_as_data(spark):
    df = spark.createDataFrame([(1,), (0,)], "n int")
    good, dead = outputs.map_catching(df, lambda r: 10 // r["n"], "bigint")
    assert_same(good, [(10,)])
    assert dead.first()["element"]["n"] == 0 and "ZeroDivisionError" in dead.first()["error"]
    many, dead = outputs.flat_map_catching(df, lambda r: [1] * (5 // r["n"]), "int")
    assert_size(many, 5)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        outputs.collect_fail_fast(outputs.try_map(df, lambda r: 10 // r["n"], "bigint"))
    parts = outputs.partition_by(df, F.when(F.col("n") > 0, "yes").otherwise("no"), "yes", "no")
    assert_same(parts["yes"], [(1,)])
    assert len(outputs.tee(df, 0)) == 0


def test_bloom_never_drops_a_partner(spark):
    big, small = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 50).withColumnRenamed("id", "s")
    kept = {r[0] for r in bloom.might_contain(big, "k", small, "s").collect()}
    assert set(range(0, 5000, 50)) <= kept and len(kept) < 1000
    assert bloom.bits_for(1) == 64


def test_display_and_logging(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (2.5,)], "value double")
    assert_equal(transforms.to_display_string(df), [("1",), ("2.5",)])
    assert_all(transforms.with_constant_key(df, 7), F.col("key") == 7)
    assert_equal(transforms.map_python(df, lambda p: pd.DataFrame({"y": p["value"] * 2}), "y double"), [(2.0,), (5.0,)])


def test_barriers(spark):
    seen = spark.sparkContext.accumulator(0)
    signal = spark.range(10).rdd.map(lambda r: (seen.add(1), r)[1]).toDF("id bigint")
    data = barriers.wait_on(spark.range(3), signal)
    assert seen.value == 10 and data.count() == 3
    assert barriers.reshuffle(spark.range(10), 5).rdd.getNumPartitions() == 5
    assert barriers.to_map(spark.createDataFrame([("a", 1)], "key string, value int")) == {"a": 1}
