import gzip
import lzma

import pytest
import zstandard
from hypothesis import given
from hypothesis import strategies as st

from millrace.sources import avro, compression, files, msgpack
from millrace.sources import services as S
from millrace.testing import assert_csv, assert_jsonl, assert_same, csv_file, jsonl_file

ROWS = [(1, "ä", 1.5), (2, None, -2.0), (3, "c,\"d\"", 0.0)]
SCHEMA = "id bigint, name string, value double"
AVRO = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "value", "type": "double"}]}


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("single", [True, False])
def test_round_trips(spark, frame, tmp_path, single):
    for name, write, read in (
        ("a.jsonl", files.write_jsonl, lambda p: files.read_jsonl(spark, p, SCHEMA)),
        ("a.jsonl.gz", files.write_jsonl, lambda p: files.read_jsonl(spark, p, SCHEMA)),
        ("a.csv", files.write_csv, lambda p: files.read_csv(spark, p, SCHEMA)),
        ("a.parquet", files.write_parquet, lambda p: files.read_parquet(spark, p)),
        ("a.msgpack", files.write_msgpack, lambda p: files.read_msgpack(spark, p, SCHEMA)),
        ("a.avro", lambda d, p, single: files.write_avro(d, p, AVRO, single), lambda p: files.read_avro(spark, p, SCHEMA)),
        ("a.xml", files.write_xml, lambda p: files.read_xml(spark, p, SCHEMA)),
        ("a.jsonl.zst", files.write_lines, lambda p: files.read_jsonl(spark, p + ("" if single else "/*"), SCHEMA, sniff=True)),
    ):
        path = str(tmp_path / "deep" / name)
        assert write(frame, path, single=single) == 3, name
        assert_same(read(path), ROWS)
        if single:
            assert (tmp_path / "deep" / name).is_file()


def test_all_tasks_take_part_in_single_files(spark, tmp_path, monkeypatch):
    rows = spark.range(60_000, numPartitions=4).selectExpr("id", "concat('é', id) AS name", "id / 2 AS value")
    want = [(i, f"é{i}", i / 2) for i in range(60_000)]
    for name, write, read in (
        ("a.jsonl.xz", files.write_lines, files.read_jsonl), ("a.jsonl.zst", files.write_lines, files.read_jsonl), ("a.msgpack", files.write_msgpack, files.read_msgpack),
        ("a.avro", lambda d, p, single: files.write_avro(d, p, AVRO, single), files.read_avro), ("a.avro.gz", lambda d, p, single: files.write_avro(d, p, AVRO, single), files.read_avro),
    ):
        path = str(tmp_path / name)
        assert write(rows, path, single=True) == 60_000
        assert list(map(tuple, read(spark, path, SCHEMA).collect())) == want, name
    raw, streams = (tmp_path / "a.jsonl.xz").read_bytes(), 0
    while raw:  # a stream from each partition
        part = lzma.LZMADecompressor()
        part.decompress(raw)
        raw, streams = part.unused_data, streams + 1
    assert streams == 4
    assert len(list(avro.read((tmp_path / "a.avro").read_bytes()))) == 60_000
    assert files.write_avro(rows.where("id < 0"), str(tmp_path / "none.avro"), AVRO, single=True) == 0 and list(avro.read((tmp_path / "none.avro").read_bytes())) == []
    monkeypatch.setattr(files, "PIECE", 200_000)
    pieces = files.read_jsonl(spark, str(tmp_path / "a.jsonl.xz"), SCHEMA)
    assert sorted(map(tuple, pieces.collect())) == want and pieces.rdd.getNumPartitions() == 4
    lines = lzma.open(tmp_path / "a.jsonl.xz").read() + b"{\n"
    (tmp_path / "bad.jsonl.xz").write_bytes(lzma.compress(lines))
    with pytest.raises(Exception, match="line 60001"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl.xz"), SCHEMA).collect()


def test_codecs_and_globs(spark, tmp_path):
    raw = b'{"id": 1}\n\n{"id": 2}\n'
    (tmp_path / "x.jsonl.xz").write_bytes(lzma.compress(raw))
    (tmp_path / "y.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(raw))
    assert files.read_jsonl(spark, str(tmp_path / "*.jsonl.*"), "id bigint").count() == 4
    (tmp_path / "noext").write_bytes(gzip.compress(raw))
    assert files.read_jsonl(spark, str(tmp_path / "noext"), "id bigint", sniff=True).count() == 2
    assert len(files.expand_glob(spark, str(tmp_path / "*.jsonl.*"))) == 2
    assert files.expand_glob(spark, str(tmp_path / "none*")) == []
    with pytest.raises(FileNotFoundError):
        files.expand_glob(spark, str(tmp_path / "none*"), required=True)
    (tmp_path / "bad.jsonl").write_text('{"id": 1}\n{"id": \n')
    with pytest.raises(Exception):  # noqa: B017
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "id bigint").collect()
    assert files.read_text(spark, str(tmp_path / "bad.jsonl")).count() == 2
    with pytest.raises(ValueError):
        files.write_jsonl(spark.range(1), str(tmp_path / "a.jsonl.xz"))
    compression.register_codec(compression.Codec("none", (".plain",), b"", bytes, bytes))
    assert compression.by_extension("a.plain").name == "none"


_values = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False) | st.text(max_size=40) | st.binary(max_size=300), lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=5), x, max_size=20), max_leaves=30)


@given(st.lists(_values, max_size=5))
def test_msgpack(xs):
    assert list(msgpack.unpack_all(b"".join(map(msgpack.pack, xs)))) == xs


def test_msgpack_cut_short():
    with pytest.raises(ValueError, match="truncated"):
        list(msgpack.unpack_all(msgpack.pack("hello")[:-1]))


@pytest.mark.parametrize("codec", sorted(avro.CODECS))
def test_avro(codec):
    schema = {"type": "record", "name": "r", "fields": [
        {"name": "n", "type": "long"}, {"name": "x", "type": ["null", "double"]}, {"name": "l", "type": {"type": "array", "items": "string"}}, {"name": "m", "type": {"type": "map", "values": "int"}},
        {"name": "e", "type": {"type": "enum", "name": "k", "symbols": ["A", "B"]}}, {"name": "f", "type": {"type": "fixed", "name": "two", "size": 2}}, {"name": "b", "type": "boolean"}]}
    rows = [{"n": i - (1 << 40), "x": None if i % 2 else i / 3, "l": ["é"] * (i % 3), "m": {"a": i}, "e": "B", "f": b"xy", "b": True} for i in range(9)]
    assert list(avro.read(avro.write(rows, schema, codec, block=4))) == rows
    fewer = {"type": "record", "name": "r", "fields": [{"name": "n", "type": "long"}, {"name": "new", "type": "int", "default": 7}]}
    assert next(iter(avro.read(avro.write(rows, schema), fewer))) == {"n": -(1 << 40), "new": 7}
    with pytest.raises(ValueError):
        list(avro.read(b"nope"))


def test_services():
    store = S.MemoryObjects()
    for key in ("d/a.jsonl.gz", "d/e/b.jsonl"):
        S.write_jsonl_object(store, "bk", key, [{"k": key}])
    assert S.glob_keys(store, "bk", "d/*.gz") == ["d/a.jsonl.gz"] and len(S.read_jsonl_objects(store, "bk", "d/**")) == 2
    with pytest.raises(S.ServiceError):
        S.glob_keys(store, "bk", "x*", required=True)
    pauses, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise S.ServiceError("network")
        return "ok"

    call = S.Call(sleep=pauses.append)
    assert call.run(flaky) == "ok" and pauses == [0.1, 0.2]
    with pytest.raises(S.ServiceError):
        call.run(lambda: (_ for _ in ()).throw(S.ServiceError("invalid")))
    assert call.batches(list(range(5)), 2, lambda c: [sum(c)]) == [1, 5, 4]
    assert list(call.pages(lambda t: ([t], None if t == "b" else "b"))) == [None, "b"]
    assert call.parallel(lambda: 1, lambda: 2) == [1, 2] and call.each([1, 2], lambda x: -x) == [-1, -2]
    times = iter((0.0, 9.0))
    with pytest.raises(S.ServiceError, match="took"):
        call.retrying(timeout=1.0, clock=lambda: next(times)).run(lambda: 1)
    pool = S.Pool(object, 1)
    with pool.connection() as a, pytest.raises(S.ServiceError), pool.connection(timeout=0.01):
        pass
    with pool.connection() as b:
        assert a is b
    assert S.parse_uri("s3://bk/a/b") == ("s3", "bk", "a/b") and S.valid_name("abc") and S.valid_key("a/b")
    for bad in (lambda: S.parse_uri("x"), lambda: S.valid_name("A"), lambda: S.valid_key("a/../b"), lambda: S.from_env("P_", ["x"], {})):
        with pytest.raises(S.ServiceError):
            bad()
    assert S.from_env("P_", ["x"], {"P_X": "1"}) == {"x": "1"}
    q = S.MemoryQueue()
    q.send(b"m")
    assert q.receive()[0][1] == b"m" and q.receive() == []
    ps = S.MemoryPubSub()
    ps.subscribe("t", "s")
    ps.publish("t", b"1", b"2")
    ps.ack("s", ps.pull("s")[0][0])
    assert [m for _, m in ps.pull("s")] == [b"2"]
    clock = [0.0]
    cache = S.MemoryCache(lambda: clock[0])
    cache.set("a", 1, ttl=5)
    clock[0] = 6.0
    assert cache.get("a") is None and cache.increment("n", 2) == 2
    db = S.MemoryDatabase()
    with pytest.raises(RuntimeError), db.transaction():
        db.insert("t", {"a": 1})
        raise RuntimeError
    assert db.query("t") == []
    g = S.MemoryGraph()
    g.add_edge("a", "b", "x")
    assert g.neighbours("a") == ["b"] and g.neighbours("a", "y") == []
    s = S.MemorySearch()
    s.index("d", "Hello world")
    assert s.search("hello") == ["d"]
    m = S.MemoryMetrics()
    m.put("x", 1.0, 5)
    assert m.query("x", 0, 6) == [(5, 1.0)]
    c = S.MemoryConfig()
    c.set_secret("k", "v")
    assert c.names() == ["k"] and c.secret("k") == "v"
    n = S.MemoryNotifications()
    got = []
    n.subscribe("t", got.append)
    assert n.send("t", "hi") == 1 and got == ["hi"]
    assert S.MemoryFunctions(f=lambda x: x + 1).predict_batch("f", [1, 2]) == [2, 3]


def test_warehouse_and_mock_files(spark, tmp_path):
    p = jsonl_file(tmp_path / "a.jsonl", [{"id": 1}])
    assert_jsonl(p, [{"id": 1}])
    c = csv_file(tmp_path / "a.csv", ["id"], [[1]])
    assert_csv(c, [("id",), ("1",)])
    w = S.SparkWarehouse(spark)
    w.load("wt", p, "json")
    assert w.table_exists("wt") and w.query("select id from wt") == [{"id": 1}] and w.schema("wt") == {"id": "bigint"}
    w.export("select * from wt", str(tmp_path / "out"))
