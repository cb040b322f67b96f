"""Registered queries over the star-schema tables, each with the SQL that gives the same rows.

Money is summed in whole cents, so that sums don't depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import bloom, text, validation
from millrace.functions import combiners as C
from millrace.operators import batches, filters, joins, keyed, outputs, sampling, sets, transforms, windows
from millrace.plans import barriers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Registers a function of Tables under its name, with its SQL."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


CENTS = "CAST(round({0} * 100) AS BIGINT)"
PRICE = CENTS.format("l_extendedprice")
HOUR = 3_600_000


@query(f"""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum({PRICE}) AS BIGINT) AS sum_cents,
CAST(sum({PRICE}) AS DOUBLE) / count(*) AS avg_cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t: Tables) -> DataFrame:
    rows = filters.filter_rows(t.lineitem, F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return keyed.combine_per_key(rows, ["l_returnflag", "l_linestatus"], sum_qty=C.total("l_quantity"), sum_cents=C.total(cents("l_extendedprice")), avg_cents=F.sum(cents("l_extendedprice")).cast("double") / F.count(F.lit(1)), n=C.count())


# Row transforms


@query("SELECT o_orderkey, upper(o_orderpriority) AS priority, CAST(year(o_orderdate) AS BIGINT) AS ordered FROM orders")
def map_rows(t: Tables) -> DataFrame:
    return transforms.map_rows(t.orders, o_orderkey="o_orderkey", priority="upper(o_orderpriority)", ordered=F.year("o_orderdate").cast("long"))


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def flat_map(t: Tables) -> DataFrame:
    return transforms.flat_map(t.part, F.split("p_name", " "))


@query("SELECT p_partkey * 2 AS value FROM part WHERE p_size > 25")
def filter_map(t: Tables) -> DataFrame:
    return transforms.filter_map(t.part, F.when(F.col("p_size") > 25, F.col("p_partkey") * 2))


@query("SELECT o_orderpriority AS key, count(*) AS count FROM orders GROUP BY ALL")
def key_by_and_count(t: Tables) -> DataFrame:
    return keyed.count_per_key(transforms.key_by(t.orders, "o_orderpriority"), "key")


@query("SELECT 'all' AS key, count(*) AS count FROM nation")
def constant_key(t: Tables) -> DataFrame:
    return keyed.count_per_key(transforms.with_constant_key(t.nation, "all"), "key")


@query("SELECT n_name AS key, n_regionkey AS value FROM nation")
def swap_keys(t: Tables) -> DataFrame:
    return transforms.swap_keys(t.nation.select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("value")))


@query("SELECT c_nationkey AS key, CAST(c_custkey * 10 AS BIGINT) AS value FROM customer")
def map_values(t: Tables) -> DataFrame:
    return transforms.map_values(t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("value")), F.col("value") * 10)


@query("SELECT CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def display_string(t: Tables) -> DataFrame:
    return transforms.to_display_string(t.lineitem, "l_quantity").groupBy("value").agg(C.count().alias("n"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events")
def reify_timestamps(t: Tables) -> DataFrame:
    stamped = transforms.attach_timestamps(t.events.select("event_id", windows.millis("ts").alias("ms")), "ms")
    return transforms.reify_timestamps(stamped.drop("ms")).select("event_id", "ts_ms")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey >= 2")
def compose_steps(t: Tables) -> DataFrame:
    return transforms.compose(t.nation, lambda d: d.where("n_regionkey >= 1"), lambda d: d.where("n_regionkey <> 1"))


# Filters

_FILTERS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "filter_eq": (lambda d: filters.filter_eq(d, "o_orderstatus", "F"), "o_orderstatus = 'F'"),
    "filter_ne": (lambda d: filters.filter_ne(d, "o_orderstatus", "F"), "o_orderstatus IS DISTINCT FROM 'F'"),
    "filter_lt": (lambda d: filters.filter_lt(d, "o_totalprice", 1000.0), "o_totalprice < 1000"),
    "filter_le": (lambda d: filters.filter_le(d, "o_custkey", 50), "o_custkey <= 50"),
    "filter_gt": (lambda d: filters.filter_gt(d, "o_totalprice", 400000.0), "o_totalprice > 400000"),
    "filter_ge": (lambda d: filters.filter_ge(d, "o_custkey", 100), "o_custkey >= 100"),
    "filter_range": (lambda d: filters.filter_range(d, "o_custkey", 10, 20), "o_custkey >= 10 AND o_custkey < 20"),
    "filter_range_inclusive": (lambda d: filters.filter_range_inclusive(d, "o_custkey", 10, 20), "o_custkey BETWEEN 10 AND 20"),
    "filter_by": (lambda d: filters.filter_by(d, F.length("o_orderpriority"), lambda c: c > 6), "length(o_orderpriority) > 6"),
    "filter_values": (lambda d: filters.filter_values(transforms.map_values(d, F.col("o_custkey") % 7, "o_custkey7"), "o_custkey7 = 3").drop("o_custkey7"), "o_custkey % 7 = 3"),
}


def _filtered(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir).orders).select("o_orderkey", "o_custkey", "o_orderstatus")


for _name, (_fn, _sql) in _FILTERS.items():
    QUERIES[_name] = _filtered(_fn)
    ORACLE_SQL[_name] = f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE {_sql}"

# Joins.  Keys with nulls and keys without partners are made on both sides; all rows take part.

_ORDERS = "SELECT o_orderkey, CASE WHEN o_custkey % 500 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN -1 - o_custkey ELSE o_custkey END AS key FROM orders"
_CUSTOMERS = "SELECT c_name, CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 1000000000 + c_custkey ELSE c_custkey END AS key FROM customer"


def _sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    o, c = F.col("o_custkey"), F.col("c_custkey")
    left = t.orders.select("o_orderkey", F.when(o % 500 == 0, F.lit(None)).when(o % 10 == 1, -1 - o).otherwise(o).alias("key"))
    right = t.customer.select("c_name", F.when(c % 50 == 0, F.lit(None)).when(c % 3 == 1, 1_000_000_000 + c).otherwise(c).alias("key"))
    return left, right


def _joined(how: str) -> Query:
    return lambda spark, sf_dir: joins.join(*_sides(Tables(spark, sf_dir)), "key", how)


for _how in ("inner", "left", "right", "full"):
    QUERIES[f"join_{_how}"] = _joined(_how)
    _key = {"inner": "l.key", "left": "l.key", "right": "r.key", "full": "coalesce(l.key, r.key)"}[_how]
    ORACLE_SQL[f"join_{_how}"] = f"SELECT {_key} AS key, o_orderkey, c_name FROM ({_ORDERS}) l {_how.upper()} JOIN ({_CUSTOMERS}) r ON l.key IS NOT DISTINCT FROM r.key"


@query(f"""SELECT r_name, n_name, count(*) AS n, CAST(sum({CENTS.format('o_totalprice')}) AS BIGINT) AS cents FROM region JOIN nation ON r_regionkey = n_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def multiway_join(t: Tables) -> DataFrame:
    places = joins.join_inner(t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), t.region, "r_regionkey")
    people = joins.join_inner(t.customer.withColumnRenamed("c_nationkey", "n_nationkey"), places, "n_nationkey")
    orders = joins.join_inner(t.orders.withColumnRenamed("o_custkey", "c_custkey"), people, "c_custkey")
    return keyed.combine_per_key(orders, ["r_name", "n_name"], n=C.count(), cents=C.total(cents("o_totalprice")))


@query("""SELECT n_nationkey AS key, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS suppliers, n_name AS nations
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def cogroup_three(t: Tables) -> DataFrame:
    grouped = joins.cogroup(
        "key", customers=t.customer.select(F.col("c_nationkey").alias("key"), "c_custkey"), suppliers=t.supplier.select(F.col("s_nationkey").alias("key"), "s_suppkey"),
        nations=t.nation.select(F.col("n_nationkey").alias("key"), "n_name"))
    return grouped.select("key", F.size("customers").cast("long").alias("customers"), F.size("suppliers").cast("long").alias("suppliers"), F.array_join(F.col("nations")["n_name"], ",").alias("nations"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def side_map(t: Tables) -> DataFrame:
    lookup = t.nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.map_with_side(t.customer, lookup, "c_nationkey").select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def side_filter(t: Tables) -> DataFrame:
    return joins.filter_with_side(t.customer, t.nation.where("n_regionkey = 1").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) + 1000 FROM customer)")
def side_singleton_filter(t: Tables) -> DataFrame:
    mean = joins.side_singleton(t.customer.agg((F.avg("c_acctbal") + 1000).alias("m")), "m")
    return joins.filter_with_singleton(t.customer, mean, lambda m: F.col("c_acctbal") > m).select("c_custkey")


@query("SELECT r_regionkey, CAST(count(n_nationkey) AS BIGINT) AS nations FROM region LEFT JOIN nation ON r_regionkey = CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey + 1 ELSE n_regionkey * 2 + 2 END GROUP BY ALL")
def side_multimap(t: Tables) -> DataFrame:
    many = t.nation.select(F.expr("CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey + 1 ELSE n_regionkey * 2 + 2 END").alias("r_regionkey"), "n_nationkey")
    return joins.map_with_side_multimap(t.region, many, "r_regionkey").select("r_regionkey", F.size("values").cast("long").alias("nations"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL")
def bloom_join(t: Tables) -> DataFrame:
    few = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.join_inner(bloom.might_contain(t.lineitem.select("l_orderkey"), "l_orderkey", few, "l_orderkey"), few, "l_orderkey").groupBy("l_orderkey").agg(C.count().alias("n"))


# Aggregates


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_partkey) AS BIGINT) AS total, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
CAST(sum(l_partkey) AS DOUBLE) / count(*) AS mean, count(DISTINCT l_suppkey) AS suppliers FROM lineitem""")
def global_aggregates(t: Tables) -> DataFrame:
    return keyed.combine_globally(t.lineitem, n=C.count(), total=C.total("l_partkey"), low=C.least("l_extendedprice"), high=C.greatest("l_extendedprice"), mean=C.average("l_partkey"), suppliers=C.distinct_count("l_suppkey"))


@query("SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, CAST(NULL AS DOUBLE) AS low, CAST(0 AS DOUBLE) AS mean")
def empty_aggregates(t: Tables) -> DataFrame:
    return keyed.combine_globally(t.lineitem.where("l_orderkey < 0"), n=C.count(), total=C.total("l_partkey"), low=C.least("l_extendedprice"), mean=C.average("l_extendedprice"))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY ALL")
def count_per_element(t: Tables) -> DataFrame:
    return keyed.count_per_element(t.events, "event_type")


@query("SELECT o_custkey, CAST(sum(o_orderkey) AS BIGINT) AS sum, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(sum(o_orderkey) AS DOUBLE) / count(*) AS average FROM orders GROUP BY ALL")
def numbers_per_key(t: Tables) -> DataFrame:
    return keyed.combine_per_key(t.orders, "o_custkey", sum=C.total("o_orderkey"), low=C.least("o_totalprice"), high=C.greatest("o_totalprice"), average=C.average("o_orderkey"))


@query('SELECT l_suppkey, CAST(count(DISTINCT l_partkey) AS BIGINT) AS "distinct" FROM lineitem GROUP BY ALL')
def distinct_count_per_key(t: Tables) -> DataFrame:
    return keyed.distinct_count_per_key(t.lineitem, "l_suppkey", "l_partkey")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY ALL")
def group_by_key(t: Tables) -> DataFrame:
    grouped = keyed.group_by_key(t.nation, "n_regionkey", "n_name", order_by=["n_nationkey"])
    return grouped.select("n_regionkey", F.array_join("values", ",").alias("names"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS values FROM orders GROUP BY ALL")
def to_set_per_key(t: Tables) -> DataFrame:
    return keyed.to_set_per_key(t.orders, "o_custkey", "o_orderstatus").select("o_custkey", F.array_join("values", ",").alias("values"))


@query("SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS values FROM events")
def to_set_globally(t: Tables) -> DataFrame:
    return keyed.to_set_globally(t.events, "event_type").select(F.array_join("values", ",").alias("values"))


@query("SELECT n_regionkey AS key, arg_max(n_name, n_nationkey) AS value FROM nation GROUP BY ALL")
def to_dict(t: Tables) -> DataFrame:
    return keyed.to_dict(t.nation, "n_regionkey", "n_name", "n_nationkey").select(F.explode("map"))


@query("SELECT user_id, arg_max(event_id, ts) AS latest FROM events GROUP BY ALL")
def latest_per_key(t: Tables) -> DataFrame:
    return keyed.latest_per_key(t.events, "user_id", "event_id", "ts", "event_id")


@query("SELECT arg_max(event_id, ts) AS latest FROM events")
def latest_globally(t: Tables) -> DataFrame:
    return keyed.latest_globally(t.events, "event_id", "ts", "event_id")


@query("SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY ALL")
def exact_quantiles(t: Tables) -> DataFrame:
    q = F.col("q")
    return keyed.combine_per_key(t.lineitem, "l_returnflag", q=C.exact_quantiles("l_quantity", [0.25, 0.5, 0.75])).select("l_returnflag", q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY ALL")
def approx_quantiles(t: Tables) -> DataFrame:
    both = keyed.combine_per_key(t.lineitem, "l_returnflag", a=C.approx_quantiles("l_quantity", [0.1, 0.5, 0.9]), e=C.exact_quantiles("l_quantity", [0.1, 0.5, 0.9]))
    return both.select("l_returnflag", F.forall(F.zip_with("a", "e", lambda a, e: F.abs(a - e) <= 1.0), lambda ok: ok).alias("near"))


@query("SELECT l_returnflag, true AS near FROM lineitem GROUP BY ALL")
def approx_median(t: Tables) -> DataFrame:
    both = keyed.combine_per_key(t.lineitem, "l_returnflag", a=C.approx_median("l_quantity"), e=C.exact_quantiles("l_quantity", [0.5]))
    return both.select("l_returnflag", (F.abs(F.col("a") - F.col("e")[0]) <= 1.0).alias("near"))


@query("SELECT true AS hll, true AS kmv")
def approx_distinct(t: Tables) -> DataFrame:
    exact = keyed.distinct_count_globally(t.lineitem, "l_orderkey", "e")
    hll = keyed.approx_count_distinct(t.lineitem, "l_orderkey", into="h")
    kmv = keyed.kmv_distinct(t.lineitem, "l_orderkey", 1024, into="k")
    near = lambda c: F.abs(F.col(c) - F.col("e")) <= 0.15 * F.col("e")
    one = F.lit(1)
    both = exact.withColumn("i", one).join(hll.withColumn("i", one), "i").join(kmv.withColumn("i", one), "i")
    return both.select(near("h").alias("hll"), near("k").alias("kmv"))


@query("SELECT DISTINCT l_suppkey, true AS some FROM lineitem")
def approx_distinct_per_key(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(C.approx_distinct("l_partkey").alias("a")).select("l_suppkey", (F.col("a") > 0).alias("some"))


@query("SELECT l_suppkey, true AS near FROM lineitem GROUP BY ALL")
def kmv_distinct_per_key(t: Tables) -> DataFrame:
    exact = keyed.distinct_count_per_key(t.lineitem, "l_suppkey", "l_partkey", "e")
    return joins.join_inner(exact, keyed.kmv_distinct(t.lineitem, "l_partkey", 1 << 20, "l_suppkey", "k"), "l_suppkey").select("l_suppkey", (F.col("e") == F.col("k")).alias("near"))


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def python_combiner(t: Tables) -> DataFrame:
    return C.python_combiner(t.lineitem, ["l_returnflag"], "l_linenumber", int, lambda a, x: a + int(x), lambda a, b: a + b, int, "total bigint")


@query("SELECT o_orderpriority, CAST(max(n) AS BIGINT) AS most FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL")
def lifted_combine(t: Tables) -> DataFrame:
    return keyed.max_per_key(t.orders.groupBy("o_orderpriority", "o_custkey").agg(C.count().alias("n")), "o_orderpriority", "n", "most")


@query("SELECT l_linestatus, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY ALL")
def salted_combine(t: Tables) -> DataFrame:
    return keyed.combine_salted(t.lineitem.select("l_linestatus", "l_partkey", "l_orderkey", "l_linenumber"), "l_linestatus", {"total": F.sum("l_partkey")}, {"total": F.sum("total")})


# Sets, top-k, samples


@query("SELECT DISTINCT n FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def flatten_distinct(t: Tables) -> DataFrame:
    return sets.distinct(sets.flatten(t.customer.select(F.col("c_nationkey").alias("n")), t.supplier.select(F.col("s_nationkey").alias("n"))))


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def distinct_per_key(t: Tables) -> DataFrame:
    return sets.distinct_per_key(t.orders, "o_custkey", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def distinct_by(t: Tables) -> DataFrame:
    return sets.distinct_by(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def distinct_texts(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_k_per_key(t: Tables) -> DataFrame:
    return sets.top_k_per_key(t.orders, "o_custkey", "o_totalprice", 3, ["o_orderkey"]).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def bottom_k_per_key(t: Tables) -> DataFrame:
    return sets.bottom_k_per_key(t.orders, "o_custkey", "o_totalprice", 2, ["o_orderkey"]).select("o_custkey", "o_orderkey", "rank")


@query("SELECT string_agg(k, ',' ORDER BY o_orderkey DESC) AS top FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders ORDER BY o_orderkey DESC LIMIT 5)")
def top_k_globally(t: Tables) -> DataFrame:
    return sets.top_k_globally(t.orders, "o_orderkey", 5).select(F.array_join("top", ",").alias("top"))


@query("SELECT string_agg(k, ',' ORDER BY o_orderkey) AS bottom FROM (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders ORDER BY o_orderkey LIMIT 5)")
def bottom_k_globally(t: Tables) -> DataFrame:
    return sets.bottom_k_globally(t.orders, "o_orderkey", 5).select(F.array_join("bottom", ",").alias("bottom"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def take_in_order(t: Tables) -> DataFrame:
    return sets.take(t.orders, 10, [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey")


@query("SELECT 100 AS n, true AS from_table")
def sample_rows(t: Tables) -> DataFrame:
    some = sampling.sample_rows(t.customer.select("c_custkey"), 100)
    return joins.filter_with_side(some, t.customer.select("c_custkey"), "c_custkey").agg(F.count(F.lit(1)).cast("int").alias("n"), F.lit(True).alias("from_table"))


@query("SELECT o_custkey, CAST(least(count(*), 2) AS BIGINT) AS n FROM orders GROUP BY ALL")
def sample_per_key(t: Tables) -> DataFrame:
    return sampling.sample_list_per_key(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", 2).select("o_custkey", F.size("sample").cast("long").alias("n"))


# Windows

_WINDOW = f"(epoch_us(ts) // {HOUR}000) * {HOUR}"


@query(f"""SELECT {_WINDOW} AS window_start, {_WINDOW} + {HOUR} AS window_end, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total, min(value) AS low, max(value) AS high,
CAST(sum(user_id) AS DOUBLE) / count(*) AS mean FROM events GROUP BY ALL""")
def window_aggregates(t: Tables) -> DataFrame:
    return windows.combine_per_window(t.events, "ts", HOUR, n=C.count(), total=C.total("user_id"), low=C.least("value"), high=C.greatest("value"), mean=C.average("user_id"))


@query(f"""SELECT {_WINDOW} AS window_start, {_WINDOW} + {HOUR} AS window_end, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total, min(value) AS low, max(value) AS high,
CAST(sum(user_id) AS DOUBLE) / count(*) AS mean FROM events GROUP BY ALL""")
def keyed_window_aggregates(t: Tables) -> DataFrame:
    return windows.combine_per_window(t.events, "ts", HOUR, 0, ["event_type"], n=C.count(), total=C.total("user_id"), low=C.least("value"), high=C.greatest("value"), mean=C.average("user_id"))


@query(f"SELECT ((epoch_us(ts) - 600000000) // {HOUR}000) * {HOUR} + 600000 AS window_start, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def group_by_window(t: Tables) -> DataFrame:
    grouped = windows.group_by_window(t.events, "ts", "event_id", HOUR, 600_000, order_by=["event_id"])
    return grouped.select("window_start", F.array_join("values", ",").alias("ids"))


@query(f"SELECT event_type, {_WINDOW} AS window_start, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM events GROUP BY ALL")
def group_by_key_and_window(t: Tables) -> DataFrame:
    grouped = windows.group_by_window(t.events, "ts", "event_id", HOUR, 0, ["event_type"], ["event_id"])
    return grouped.select("event_type", "window_start", F.array_join("values", ",").alias("ids"))


# Text and validation


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+')")
def regex_matches(t: Tables) -> DataFrame:
    return text.matches(t.pages, "url", "/[a-z]{2}/[0-9]+").select("page_id")


@query("SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS value, count(*) AS n FROM pages WHERE regexp_matches(url, '^https?://([^/]+)') GROUP BY ALL")
def regex_extract(t: Tables) -> DataFrame:
    return text.extract(t.pages, "url", "^https?://([^/]+)").groupBy("value").agg(C.count().alias("n"))


@query("SELECT regexp_extract(url, '/([a-z]+)/([0-9]+)', 1) AS key, regexp_extract(url, '/([a-z]+)/([0-9]+)', 2) AS value FROM pages WHERE regexp_matches(url, '/([a-z]+)/([0-9]+)')")
def regex_extract_pairs(t: Tables) -> DataFrame:
    return text.extract_pairs(t.pages, "url", "/([a-z]+)/([0-9]+)")


@query("SELECT regexp_extract(url, '[0-9]+', 0) AS value FROM pages WHERE regexp_matches(url, '[0-9]+')")
def regex_find(t: Tables) -> DataFrame:
    return text.find(t.pages, "url", "[0-9]+")


@query("SELECT p_partkey, regexp_replace(p_name, '([a-z])[a-z]*', '\\1.', 'g') AS p_name FROM part")
def regex_replace_all(t: Tables) -> DataFrame:
    return text.replace_all(t.part, "p_name", "([a-z])[a-z]*", "$1.").select("p_partkey", "p_name")


@query("SELECT unnest(string_split_regex(url, '[/?#=&]')) AS value FROM pages")
def regex_split(t: Tables) -> DataFrame:
    return text.split(t.pages, "url", "[/?#=&]")


@query("""SELECT c_custkey, (CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN '' ELSE 'IN_RANGE;' END || CASE WHEN contains(c_name, '7') THEN '' ELSE 'CONTAINS;' END
|| CASE WHEN strlen(c_mktsegment) >= 9 THEN '' ELSE 'MIN_LENGTH;' END) AS codes FROM customer""")
def validation_errors(t: Tables) -> DataFrame:
    rules = [validation.in_range("c_acctbal", 0, 9000), validation.contains("c_name", "7"), validation.min_length("c_mktsegment", 9)]
    return validation.with_errors(t.customer, rules).select("c_custkey", F.concat_ws("", F.transform("errors", lambda e: F.concat(e["code"], F.lit(";")))).alias("codes"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND length(c_name) > 0 AND strlen(c_mktsegment) <= 9")
def validate_skip(t: Tables) -> DataFrame:
    return validation.skip_invalid(t.customer, [validation.in_range("c_acctbal", 0, 5000), validation.not_empty("c_name"), validation.max_length("c_mktsegment", 9)]).select("c_custkey")


@query("""SELECT c_custkey, c_custkey % 4 IN (0, 1) AS valid FROM customer""")
def validate_email(t: Tables) -> DataFrame:
    address = F.element_at(F.array(F.concat("c_name", F.lit("@example.com")), F.lit("a@b.c"), F.lit("@b.c"), F.lit("a@b.")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", validation.email(address).alias("valid"))


@query("SELECT o_orderkey AS value, 'odd customer' AS error FROM orders WHERE o_custkey % 2 = 1")
def dead_letters(t: Tables) -> DataFrame:
    _, dead = outputs.expression_catching(t.orders, F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey")), "odd customer")
    return dead.select(F.col("element")["o_orderkey"].alias("value"), "error")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 3 THEN NULL ELSE CAST(trunc(10 / (r_regionkey - 3)) AS BIGINT) END AS value, r_regionkey = 3 AS failed FROM region")
def try_map(t: Tables) -> DataFrame:
    tried = outputs.try_map(t.region, lambda r: int(10 / (r["r_regionkey"] - 3)), "bigint")
    return tried.select("r_regionkey", F.col("result")["value"].alias("value"), F.col("result")["error"].isNotNull().alias("failed"))


@query("SELECT 'cheap' AS part, count(*) AS n FROM orders WHERE o_totalprice < 100000 UNION ALL SELECT 'dear', count(*) FROM orders WHERE o_totalprice >= 100000")
def partition_outputs(t: Tables) -> DataFrame:
    parts = outputs.partition(t.orders, cheap=F.col("o_totalprice") < 100000, dear=F.col("o_totalprice") >= 100000)
    return sets.flatten(*(d.agg(C.count().alias("n")).select(F.lit(name).alias("part"), "n") for name, d in parts.items()))


@query("SELECT count(*) * 2 AS n FROM nation")
def tee(t: Tables) -> DataFrame:
    return keyed.count_globally(sets.flatten(*outputs.tee(t.nation)), "n")


# Batches and barriers


@query("""SELECT l_suppkey, b AS batch_no, CAST(count(*) AS BIGINT) AS n, CAST(min(l_orderkey) AS BIGINT) AS first FROM (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 100 AS b FROM lineitem) GROUP BY ALL""")
def group_into_batches(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber")
    done = batches.group_into_batches(rows, "l_suppkey", 100, ["l_orderkey", "l_linenumber"])
    return done.select("l_suppkey", "batch_no", F.size("batch").cast("long").alias("n"), F.col("batch")[0]["l_orderkey"].alias("first"))


@query("SELECT b AS batch_no, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS b FROM orders) GROUP BY ALL")
def batch_ordered(t: Tables) -> DataFrame:
    done = batches.batch_ordered(t.orders.select("o_orderkey"), 1000, ["o_orderkey"])
    return done.select("batch_no", F.size("batch").cast("long").alias("n"), F.col("batch")[0]["o_orderkey"].alias("first"))


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total, true AS small FROM orders")
def batch_elements(t: Tables) -> DataFrame:
    done = batches.batch_elements(t.orders.select("o_orderkey"), 64)
    return done.select(F.size("batch").alias("k"), F.aggregate("batch", F.lit(0).cast("long"), lambda a, r: a + r["o_orderkey"]).alias("s")).agg(F.sum("s").alias("total"), (F.max("k") <= 64).alias("small"))


@query("SELECT CAST(sum(o_orderkey) AS BIGINT) AS total, true AS small FROM orders")
def batch_by_size(t: Tables) -> DataFrame:
    done = batches.batch_by_size(t.orders.select("o_orderkey", "o_orderpriority"), 200, F.octet_length("o_orderpriority"))
    size = F.aggregate("batch", F.lit(0), lambda a, r: a + F.octet_length(r["o_orderpriority"]))
    return done.select(size.alias("k"), F.aggregate("batch", F.lit(0).cast("long"), lambda a, r: a + r["o_orderkey"]).alias("s")).agg(F.sum("s").alias("total"), (F.max("k") <= 200).alias("small"))


@query("SELECT o_orderkey * 2 AS value FROM orders")
def map_batches(t: Tables) -> DataFrame:
    return batches.map_batches(t.orders.select("o_orderkey"), 1000, lambda pdf: (pdf[["o_orderkey"]] * 2).rename(columns={"o_orderkey": "value"}), "value bigint")


@query("SELECT c_nationkey AS key, c_custkey + 1 AS value FROM customer")
def map_values_batches(t: Tables) -> DataFrame:
    return batches.map_values_batches(t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("value")), 100, lambda s: s + 1, "value", "bigint")


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
def reshuffled_count(t: Tables) -> DataFrame:
    return keyed.count_per_key(barriers.reshuffle(t.orders, 8, "o_orderpriority"), "o_orderpriority")


@query("SELECT r_regionkey, r_name FROM region")
def wait_on(t: Tables) -> DataFrame:
    return barriers.wait_on(t.region, t.nation.groupBy("n_regionkey").count())


# Conversations and documents


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY ALL")
def conversation_turns(t: Tables) -> DataFrame:
    return keyed.combine_per_key(t.conversations, "conv_id", roles=F.array_join(C.to_list("role", order_by=["turn"]), ","), n=C.count())


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, count(toxic) AS labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL")
def labelled_documents(t: Tables) -> DataFrame:
    return keyed.combine_per_key(joins.join_left(t.documents, t.labels, "doc_id"), "lang", n=C.count(), chars=C.total("n_chars"), labelled=F.count("toxic"))
