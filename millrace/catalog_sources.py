"""Registered queries that write tables, read them again and give the rows; and queries of the remaining operators.

Every one adds to ``catalog.QUERIES`` and ``catalog.ORACLE_SQL``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import testing
from millrace.catalog import ORACLE_SQL, QUERIES, Tables, query
from millrace.functions import combiners as C
from millrace.functions import validation
from millrace.operators import joins, keyed, outputs, sets, transforms
from millrace.plans import barriers, checkpoints, metrics, naming
from millrace.plans.staging import cut, scratch
from millrace.sources import compression, files, services

# Sources and sinks: customers, with a null and a text that needs quotes

SCHEMA = "id bigint, name string, value double"
AVRO = {"type": "record", "name": "row", "fields": [{"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "value", "type": "double"}]}
ROWS_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN c_name || ', "x" <y> & é' ELSE c_name END AS name, c_acctbal AS value FROM customer"""


def _rows(t: Tables) -> DataFrame:
    name = F.expr("""CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN c_name || ', "x" <y> & é' ELSE c_name END""")
    return t.customer.select(F.col("c_custkey").alias("id"), name.alias("name"), F.col("c_acctbal").alias("value")).repartition(max(3, t.spark.sparkContext.defaultParallelism))


Write, Read = Callable[..., int], Callable[..., DataFrame]
_JSON = (files.write_jsonl, lambda spark, path: files.read_jsonl(spark, path, SCHEMA))
_LINES = (files.write_lines, _JSON[1])
_CSV = (files.write_csv, lambda spark, path: files.read_csv(spark, path, SCHEMA))
_FORMATS: dict[str, tuple[str, Write, Read]] = {
    "jsonl": (".jsonl", *_JSON), "jsonl_gzip": (".jsonl.gz", *_JSON), "jsonl_bzip2": (".jsonl.bz2", *_JSON), "jsonl_zstd": (".jsonl.zst", *_LINES), "jsonl_xz": (".jsonl.xz", *_LINES),
    "csv": (".csv", *_CSV), "csv_gzip": (".csv.gz", *_CSV), "parquet": (".parquet", files.write_parquet, files.read_parquet),
    "xml": (".xml", files.write_xml, lambda spark, path: files.read_xml(spark, path, SCHEMA)),
    "msgpack": (".msgpack", files.write_msgpack, lambda spark, path: files.read_msgpack(spark, path, SCHEMA)),
    "avro": (".avro", lambda df, path, single=False: files.write_avro(df, path, AVRO, single), lambda spark, path: files.read_avro(spark, path, SCHEMA)),
    "avro_reader_schema": (".avro", lambda df, path, single=False: files.write_avro(df, path, AVRO, single, "null"), lambda spark, path: files.read_avro(spark, path, SCHEMA, AVRO)),
}


def _round_trip(extension: str, write: Write, read: Read, single: bool) -> Callable[[Tables], DataFrame]:
    def run(t: Tables) -> DataFrame:
        path, rows = scratch(t.spark) + extension, cut(_rows(t))
        for _ in range(2):  # the second write takes the place of the first
            written = write(rows, path, single=single)
        return read(t.spark, path).select("id", "name", "value", F.lit(written).cast("long").alias("written"))

    return run


for _name, _parts in _FORMATS.items():
    for _kind, _single in (("parts", False), ("file", True)):
        _run = _round_trip(*_parts, _single)
        QUERIES[f"io_{_name}_{_kind}"] = lambda spark, sf_dir, run=_run: run(Tables(spark, sf_dir))
        ORACLE_SQL[f"io_{_name}_{_kind}"] = f"SELECT id, name, value, (SELECT count(*) FROM customer) AS written FROM ({ROWS_SQL})"


@query(f"SELECT id, name, value, (SELECT count(*) FROM (SELECT DISTINCT id % 3 FROM ({ROWS_SQL}))) AS files FROM ({ROWS_SQL})")
def io_glob(t: Tables) -> DataFrame:
    folder, rows = scratch(t.spark), cut(_rows(t))
    for k in range(3):
        files.write_jsonl(rows.where(F.col("id") % 3 == k), f"{folder}/part{k}.jsonl", single=True)
    found = files.expand_glob(t.spark, f"{folder}/part?.jsonl", required=True)
    return files.read_jsonl(t.spark, f"{folder}/part*.jsonl", SCHEMA).withColumn("files", F.lit(len(found)).cast("long"))


@query("SELECT upper(c_name) AS line FROM customer")
def io_registered_codec(t: Tables) -> DataFrame:
    if not compression.by_extension("x.flip"):
        flip = lambda raw: bytes(x ^ 255 for x in raw)
        compression.register_codec(compression.Codec("flip", (".flip",), b"", flip, flip))
    path = scratch(t.spark) + ".jsonl.flip"
    files.write_lines(t.customer.select("c_name"), path, single=True)
    return files.read_binary(t.spark, path, _flipped(files._json_lines), "c_name string").select(F.upper("c_name").alias("line"))


def _flipped(parse: Callable) -> Callable:
    """A codec is registered on the driver only, so the tasks turn the bytes themselves."""
    return lambda raw: parse(raw if raw[:1] == b"{" else bytes(x ^ 255 for x in raw))


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def io_object_store(t: Tables) -> DataFrame:
    store = services.MemoryObjects()
    rows = [r.asDict() for r in t.region.selectExpr("r_regionkey AS id", "r_name AS name").collect()]
    for k, r in enumerate(rows):
        services.write_jsonl_object(store, "bucket", f"a/{k}.jsonl" + (".gz" if k % 2 else ""), [r])
    return transforms.from_rows(t.spark, [(r["id"], r["name"]) for r in services.read_jsonl_objects(store, "bucket", "a/*.jsonl*")], "id int, name string")


# Row transforms, side inputs, aggregates and sets that have no query elsewhere


@query("SELECT DISTINCT n_regionkey FROM nation")
def keys_only(t: Tables) -> DataFrame:
    return transforms.keys(t.nation, "n_regionkey").distinct()


@query("SELECT n_name, n_nationkey FROM nation")
def values_only(t: Tables) -> DataFrame:
    return transforms.values(t.nation, "n_regionkey")


@query("SELECT CAST(range AS BIGINT) AS v FROM range(100)")
def from_rows(t: Tables) -> DataFrame:
    return transforms.from_rows(t.spark, [(i,) for i in range(100)], "v bigint")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def filter_rows(t: Tables) -> DataFrame:
    from millrace.operators import filters

    return filters.filter_rows(t.orders, F.col("o_totalprice") > 100_000).select("o_orderkey", "o_custkey")


@query("SELECT n_regionkey AS key, max(n_nationkey) AS last FROM nation GROUP BY ALL")
def side_hash_map(t: Tables) -> DataFrame:
    return joins.side_map(t.nation, "n_regionkey", "n_nationkey").select(F.col("n_regionkey").alias("key"), F.col("n_nationkey").alias("last"))


@query("SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS rich FROM customer")
def side_singleton_map(t: Tables) -> DataFrame:
    mean = joins.side_singleton(t.customer.agg(F.avg("c_acctbal").alias("m")), "m")
    return joins.map_with_singleton(t.customer, mean, lambda df, m: df.select("c_custkey", (F.col("c_acctbal") > m).alias("rich")))


@query("SELECT r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING max(n_nationkey) > 20)")
def side_multimap_filter(t: Tables) -> DataFrame:
    many = t.nation.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    return joins.filter_with_side_multimap(t.region, many, "r_regionkey", lambda v: F.exists(v, lambda x: x["n_nationkey"] > 20)).select("r_name")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation")
def to_list_globally(t: Tables) -> DataFrame:
    return keyed.to_list_globally(t.nation.select(F.col("n_nationkey").cast("long").alias("k")), "k").select(F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT quantile_disc(l_partkey, 0.5) AS exact, true AS close FROM lineitem")
def approx_median_globally(t: Tables) -> DataFrame:
    found = keyed.approx_median_globally(t.lineitem, "l_partkey").withColumn("i", F.lit(1)).join(t.lineitem.agg(F.expr("percentile_disc(0.5) within group (order by l_partkey)").cast("long").alias("exact")).withColumn("i", F.lit(1)), "i")
    return found.select("exact", (F.abs(F.col("median") - F.col("exact")) <= 0.01 * F.col("exact")).alias("close"))


@query("SELECT min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem")
def approx_quantiles_globally(t: Tables) -> DataFrame:
    q = keyed.approx_quantiles_globally(t.lineitem, "l_partkey", [0.0, 1.0])
    return q.select(F.col("quantiles")[0].cast("long").alias("low"), F.col("quantiles")[1].cast("long").alias("high"))


@query("SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_quantity <= 25) AS DOUBLE) / count(*) AS share FROM lineitem GROUP BY ALL")
def cdf(t: Tables) -> DataFrame:
    return keyed.combine_per_key(t.lineitem, "l_returnflag", share=C.cdf("l_quantity", 25))


@query("SELECT n_regionkey, list_reverse(list_sort(list(n_nationkey)))[1:2] AS top, list_sort(list(n_nationkey))[1:2] AS bottom FROM nation GROUP BY ALL")
def top_and_bottom_combiners(t: Tables) -> DataFrame:
    return keyed.combine_per_key(t.nation, "n_regionkey", top=C.top_k("n_nationkey", 2), bottom=C.bottom_k("n_nationkey", 2))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_in_order(t: Tables) -> DataFrame:
    return sets.first(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey")


@query("SELECT n_name, CAST(row_number() OVER (ORDER BY n_name DESC) AS BIGINT) AS place FROM nation")
def collect_sorted(t: Tables) -> DataFrame:
    found = sets.collect_sorted(t.nation, F.desc("n_name"))
    return transforms.from_rows(t.spark, [(r["n_name"], k) for k, r in enumerate(found, 1)], "n_name string, place bigint")


# Errors, validation


def _inverse(row: dict) -> float:
    return 60.0 / (row["n_nationkey"] % 5)


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_nationkey % 5 <> 0 THEN 60.0::DOUBLE / (n_nationkey % 5) END AS value, n_nationkey % 5 = 0 AS failed FROM nation")
def map_catching(t: Tables) -> DataFrame:
    good, dead = outputs.map_catching(t.nation, lambda r: f"{r['n_nationkey']}:{_inverse(r)!r}", "string")
    parts = F.split("value", ":")
    fine = good.select(parts[0].cast("long").alias("k"), parts[1].cast("double").alias("value"), F.lit(False).alias("failed"))
    return fine.unionByName(dead.select(F.col("element.n_nationkey").cast("long").alias("k"), F.lit(None).cast("double").alias("value"), F.lit(True).alias("failed")))


@query("SELECT unnest(range(n_nationkey % 5)) AS value FROM nation WHERE n_nationkey % 5 <> 4")
def flat_map_catching(t: Tables) -> DataFrame:
    def some(row: dict) -> list:
        n = row["n_nationkey"] % 5
        if n == 4:
            raise ValueError("four")
        return list(range(n))

    return outputs.flat_map_catching(t.nation, some, "bigint")[0]


@query("SELECT CAST(n_nationkey AS BIGINT) AS v FROM nation")
def collected_or_failed(t: Tables) -> DataFrame:
    found = outputs.collect_fail_fast(outputs.try_map(t.nation, lambda r: int(r["n_nationkey"]), "bigint"))
    return transforms.from_rows(t.spark, [(v,) for v in found], "v bigint")


@query("SELECT c_custkey FROM customer")
def validate_fail_fast(t: Tables) -> DataFrame:
    return validation.fail_fast(t.customer, [validation.not_empty("c_name"), validation.in_range("c_custkey", 0, 1 << 40)]).select("c_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal >= 0 AS valid FROM customer")
def validate_and_log(t: Tables) -> DataFrame:
    good, bad = validation.validate(t.customer, [validation.in_range("c_acctbal", 0, 1_000_000)], "log", "c_custkey")
    return good.select(F.col("c_custkey").cast("string").alias("id"), F.lit(True).alias("valid")).unionByName(bad.select(F.col("record_id").alias("id"), F.lit(False).alias("valid")))


# Plans, checks, services


@query("SELECT n_nationkey AS key, n_name AS value FROM nation")
def to_hash_map(t: Tables) -> DataFrame:
    found = barriers.to_map(t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")))
    return transforms.from_rows(t.spark, list(found.items()), "key int, value string")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL")
def cached_twice(t: Tables) -> DataFrame:
    rows = barriers.cached(t.nation)
    return rows.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_regionkey, 'restored' AS how FROM region")
def checkpoint_restored(t: Tables) -> DataFrame:
    steps = checkpoints.Checkpoints(t.spark, "catalog", root=scratch(t.spark))
    for _ in range(2):
        rows = steps.step("regions", lambda: t.region)
    return rows.select("r_regionkey", F.lit(steps.log[-1][1]).alias("how"))


@query("SELECT count(*) AS n, CAST(sum(n_nationkey) AS DOUBLE) AS total, 2 AS gauge FROM nation")
def metrics_of_a_run(t: Tables) -> DataFrame:
    m = metrics.Metrics()
    m.count("runs")
    m.gauge("level", 2)
    watched = m.observe(t.nation, rows=F.count(F.lit(1)), total=F.sum("n_nationkey"))
    watched.collect()
    found = m.collect()
    return transforms.from_rows(t.spark, [(int(found["rows"]), float(found["total"]), int(found["level"]))], "n bigint, total double, gauge int")


@query("SELECT r_name, 'steps' AS scope FROM region")
def named_steps(t: Tables) -> DataFrame:
    with naming.named_scope(t.spark, "steps") as scope:
        rows = naming.with_name(t.region, "regions")
    return rows.select("r_name", F.lit(scope.split("/")[-1]).alias("scope"))


def _holds(check: Callable, *args: object) -> bool:
    try:
        check(*args)
    except AssertionError:
        return False
    return True


@query("""SELECT * FROM (VALUES ('all', true), ('any', true), ('contains', true), ('empty', false), ('equal', true), ('grouped', true), ('map', true), ('none', true), ('other map', false), ('other rows', false), ('same', true), ('size', true)) t(name, holds)""")
def assertions(t: Tables) -> DataFrame:
    """Which checks hold for the nations."""
    rows = t.nation.select("n_regionkey", "n_nationkey")
    own = [tuple(r) for r in rows.collect()]
    groups: dict[int, list[int]] = {}
    for region, nation in own:
        groups.setdefault(region, []).append(nation)
    sizes = {k: len(v) for k, v in groups.items()}
    counted = rows.groupBy("n_regionkey").count()
    key = F.col("n_nationkey")
    found = {
        "all": _holds(testing.assert_all, rows, key >= 0), "any": _holds(testing.assert_any, rows, key == 3), "none": _holds(testing.assert_none, rows, key < 0),
        "size": _holds(testing.assert_size, rows, len(own)), "empty": _holds(testing.assert_empty, rows), "contains": _holds(testing.assert_contains, rows, own[0], own[-1]),
        "equal": _holds(testing.assert_equal, rows.orderBy("n_regionkey", "n_nationkey"), sorted(own)), "same": _holds(testing.assert_same, rows, own[::-1]), "other rows": _holds(testing.assert_same, rows, own[1:]),
        "grouped": _holds(testing.assert_grouped, rows.groupBy("n_regionkey").agg(F.collect_list("n_nationkey")), groups),
        "map": _holds(testing.assert_map, counted, sizes), "other map": _holds(testing.assert_map, counted, {**sizes, 99: 1}),
    }
    return transforms.from_rows(t.spark, list(found.items()), "name string, holds boolean")


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(3 AS BIGINT) AS tries, r_name AS name FROM region")
def service_calls(t: Tables) -> DataFrame:
    """Keys and names through a queue, a key-value store and a paged listing; each call fails twice before it works."""
    queue, store, left = services.MemoryQueue(), services.MemoryKeyValue(), {}

    def shaky(name: str, fn: Callable[[], object]) -> object:
        left[name] = left.get(name, 0) + 1
        if left[name] < 3:
            raise services.ServiceError("unavailable", name)
        return fn()

    call = services.Call(tries=3, sleep=lambda s: None)
    rows = t.region.collect()
    for r in rows:
        store.put(f"region/{r['r_regionkey']}", r["r_name"])
        queue.send(str(r["r_regionkey"]).encode())
    found = call.each([int(body) for _, body in queue.receive(100)], lambda k: shaky(str(k), lambda: (k, left[str(k)], store.get(f"region/{k}"))))
    return transforms.from_rows(t.spark, found, "k bigint, tries bigint, name string")
