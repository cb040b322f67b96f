"""File readers and writers.

Schemas are always given and bad records end the job.  Paths may hold globs.  Formats and codecs that Spark has are read by
its own sources, with pushdown and splits; the others (MessagePack, Avro, zstd and xz text) are read file by file in the tasks, through
Spark's file systems.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import avro, compression, msgpack

Schema = str | T.StructType

#: Bytes that are encoded, compressed or parsed at a time.
PIECE = 4 << 20


def _struct(schema: Schema) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def expand_glob(spark: SparkSession, pattern: str, required: bool = False) -> list[str]:
    """The files that match, in order; an error if there are none and some are required."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(x.getPath().toString() for x in (fs.globStatus(where) or []) if x.isFile())
    if required and not found:
        raise FileNotFoundError(f"no file matches {pattern}")
    return found


def _needs_python(spark: SparkSession, path: str) -> bool:
    """Whether some file has a codec that Spark's text sources lack (or one that only the first bytes show)."""
    names = expand_glob(spark, path) or expand_glob(spark, f"{path.rstrip('/')}/*")  # the part files of a folder
    own = {c.name for n in names if (c := compression.by_extension(n))}
    return bool(own - {"gzip", "bzip2"})


def read_binary(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[dict]], schema: Schema) -> DataFrame:
    """Rows parsed from each (decompressed) file."""
    kind = _struct(schema)
    names = kind.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, raw in zip(batch["path"], batch["content"], strict=True):
                held = []
                for row in parse(compression.plain(where, raw)):
                    held.append([row.get(n) for n in names])
                    if len(held) == 10_000:
                        yield pd.DataFrame(held, columns=names, dtype=object)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, kind)


def _read_pieces(spark: SparkSession, path: str, parse: Callable[[bytes, int], Iterable[dict]], schema: Schema) -> DataFrame:
    """Rows parsed from pieces of the (decompressed) files that end with a line; ``parse`` takes a piece and the number of its first line.

    A task decompresses a file piece by piece; the pieces of large files go to all tasks.
    """
    kind = _struct(schema)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, raw in zip(batch["path"], batch["content"], strict=True):
                first = 1
                for piece in compression.chunks(where, raw, PIECE // 4):
                    yield pd.DataFrame({"first": [first], "piece": [piece]})
                    first += piece.count(b"\n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, piece in zip(batch["first"], batch["piece"], strict=True):
                rows = [[row.get(n) for n in kind.names] for row in parse(piece, first)]
                for k in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[k : k + 10_000], columns=kind.names, dtype=object)

    pieces = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, "first bigint, piece binary")
    if _size(spark, path) > PIECE // 4:
        pieces = pieces.repartition(spark.sparkContext.defaultParallelism)
    return pieces.mapInPandas(run, kind)


def _size(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(fs.getContentSummary(x.getPath()).getLength() for x in (fs.globStatus(where) or []))


def _json_lines(raw: bytes, first: int = 1) -> Iterator[dict]:
    for n, line in enumerate(raw.decode().split("\n"), first):
        if line.strip():
            try:
                yield json.loads(line)
            except ValueError as e:
                raise ValueError(f"line {n}: {e}") from e


def read_jsonl(spark: SparkSession, path: str, schema: Schema, sniff: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped.  ``sniff``: also find a codec by the first bytes of files without its extension."""
    if sniff or _needs_python(spark, path):
        return _read_pieces(spark, path, _json_lines, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: Schema, header: bool = True) -> DataFrame:
    if _needs_python(spark, path):
        kind = _struct(schema)
        lines = _read_pieces(spark, path, lambda raw, first: ({"line": x} for x in raw.decode().split("\n")[int(header and first == 1) :] if x.strip()), "line string")
        return lines.select(F.from_csv("line", kind.simpleString()[7:-1], {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").option("enforceSchema", False if header else True).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_xml(spark: SparkSession, path: str, schema: Schema, row_tag: str = "item") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """line, without line ends."""
    if _needs_python(spark, path):
        return _read_pieces(spark, path, lambda raw, _: ({"line": x} for x in raw.decode().splitlines()), "line string")
    return spark.read.text(path).withColumnRenamed("value", "line")


def read_msgpack(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Concatenated records: maps by field name, or arrays in the schema's order."""
    names = _struct(schema).names
    return read_binary(spark, path, lambda raw: (x if isinstance(x, dict) else dict(zip(names, x, strict=True)) for x in msgpack.unpack_all(raw)), schema)


def read_avro(spark: SparkSession, path: str, schema: Schema, reader_schema: str | dict | None = None) -> DataFrame:
    return read_binary(spark, path, lambda raw: avro.read(raw, reader_schema), schema)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _as_one_file(spark: SparkSession, folder: str, path: str, head: bytes | None = None) -> None:
    """Moves the part file to the path; with ``head``, that and the bytes of all part files, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    src = hadoop.Path(folder)
    fs = src.getFileSystem(conf)
    parts = sorted(x.getPath().toString() for x in (fs.globStatus(hadoop.Path(folder + "/part-*")) or []))
    target = hadoop.Path(path)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    if head is not None and (head or len(parts) > 1):
        whole = f"{folder}/.whole"
        out = fs.create(hadoop.Path(whole))
        out.write(head)
        for part in parts:
            f = fs.open(hadoop.Path(part))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(f, out, 1 << 20, False)
            f.close()
        out.close()
        parts = [whole]
    fs.delete(target, False)
    if not parts:
        fs.create(target).close()
    elif not fs.rename(hadoop.Path(parts[0]), target):
        raise OSError(f"could not move {parts[0]} to {path}")
    fs.delete(src, True)


def _written(df: DataFrame, path: str, single: bool, save: Callable[[DataFrame, str], None]) -> int:
    """Writes a folder of part files, or one file; returns the number of rows, counted on the way."""
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if not single:
        save(watched, path)
    else:
        folder = f"{path}.{uuid.uuid4().hex}"
        save(watched.coalesce(1), folder)
        _as_one_file(df.sparkSession, folder, path)
    return seen.get["n"]


_SPARK_CODECS = {"gzip": "gzip", "bzip2": "bzip2"}


def _option(path: str) -> str:
    codec = compression.by_extension(path)
    if codec and codec.name not in _SPARK_CODECS:
        raise ValueError(f"Spark has no text codec for {codec.name}; use write_lines")
    return _SPARK_CODECS[codec.name] if codec else "none"


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> int:
    """Compressed as the extension says."""
    how = _option(path)
    return _written(df, path, single, lambda d, p: d.write.mode("overwrite").option("compression", how).option("ignoreNullFields", False).json(p))


def write_csv(df: DataFrame, path: str, header: bool = True, single: bool = False) -> int:
    how = _option(path)
    return _written(df, path, single, lambda d, p: d.write.mode("overwrite").option("compression", how).option("header", header).csv(p))


def write_parquet(df: DataFrame, path: str, single: bool = False) -> int:
    return _written(df, path, single, lambda d, p: d.write.mode("overwrite").parquet(p))


def write_xml(df: DataFrame, path: str, single: bool = False) -> int:
    return _written(df, path, single, lambda d, p: d.write.mode("overwrite").format("xml").option("rootTag", "records").option("rowTag", "item").save(p))


def write_blobs(df: DataFrame, path: str, encode: Callable[[list[dict]], bytes], extension: str, single: bool = False, head: bytes | None = None) -> int:
    """Part files of bytes that ``encode`` makes of each partition's rows; what was there before goes.

    With ``head``, a file is the head and then what ``encode`` makes of any runs of rows: tasks hold one run at a time, and a
    single file is joined from the parts of all tasks.  Without it, or with a codec whose pieces can't be joined, a task
    encodes its rows at once and one task writes a single file.

    For formats that Spark can't write.  Tasks write through pyarrow's file systems, so the folder is on storage that all executors
    reach (hdfs, s3, gs and the like) or a shared local path.  A part is moved to its name when it is whole.
    """
    target = path if not single else f"{path}.{uuid.uuid4().hex}"
    if "://" not in target:
        target = "file://" + os.path.abspath(target)
    _delete(df.sparkSession, target)
    names = df.columns
    run_id = uuid.uuid4().hex
    codec = compression.by_extension(path)
    extension += codec.extensions[0] if codec else ""
    runs = head is not None and (codec is None or codec.joins)
    packed = codec.compress if codec else bytes
    top = (head or b"") if not (single and runs) else b""  # one file has it once, at its beginning

    def encoded(batches: Iterator[pd.DataFrame], seen: list[int]) -> Iterator[bytes]:
        if not runs:
            rows = [r for b in batches for r in _plain(b[names])]
            seen[0] = len(rows)
            if rows:
                yield top + encode(rows)
            return
        held, size = [top], 0
        for b in batches:
            if len(b):
                seen[0] += len(b)
                held.append(encode(_plain(b[names])))
                size += len(held[-1])
            if size >= PIECE:
                yield b"".join(held)
                held, size = [], 0
        if size:
            yield b"".join(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as filesystems
        from pyspark import TaskContext

        seen = [0]
        pieces = encoded(batches, seen)
        if (raw := next(pieces, None)) is not None:
            part = TaskContext.get()
            fs, folder = filesystems.FileSystem.from_uri(target)
            fs.create_dir(folder, recursive=True)
            name = f"{folder}/part-{part.partitionId():05d}-{run_id}{extension}"
            held = f"{folder}/.{part.taskAttemptId()}-{run_id}"  # readers pass over names with a dot
            with fs.open_output_stream(held, compression=None) as f:
                while raw is not None:
                    f.write(packed(raw))
                    raw = next(pieces, None)
            fs.move(held, name)
        yield pd.DataFrame({"n": seen})

    source = df.coalesce(1) if single and not runs else df
    n = source.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if single:
        _as_one_file(df.sparkSession, target, path if "://" in path else "file://" + os.path.abspath(path), (packed(head) if head else b"") if runs else None)
    return n


def _plain(pdf: pd.DataFrame) -> list[dict]:
    """Rows as dicts of plain Python values."""

    def value(x: object) -> object:
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return None
        if hasattr(x, "tolist") and not isinstance(x, str | bytes):
            x = x.tolist()
        if isinstance(x, list):
            return [value(y) for y in x]
        if isinstance(x, dict):
            return {k: value(v) for k, v in x.items()}
        return x

    return [{k: value(v) for k, v in row.items()} for row in pdf.to_dict("records")]


def write_msgpack(df: DataFrame, path: str, single: bool = False) -> int:
    return write_blobs(df, path, lambda rows: b"".join(map(msgpack.pack, rows)), ".msgpack", single, b"")


def write_avro(df: DataFrame, path: str, schema: str | dict, single: bool = False, codec: str = "deflate") -> int:
    sync = os.urandom(16)
    return write_blobs(df, path, lambda rows: avro.blocks(rows, schema, codec, sync), ".avro", single, avro.header(schema, codec, sync))


def write_lines(df: DataFrame, path: str, single: bool = False) -> int:
    """JSON lines with any registered codec, by the path's extension."""
    return write_blobs(df, path, lambda rows: "".join(json.dumps(r, default=str) + "\n" for r in rows).encode(), ".jsonl", single, b"")
