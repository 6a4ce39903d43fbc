"""Readers of the forms in which corpora come. A schema is given wherever one is known: nothing is read twice to infer it."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str | None


def _reader(spark: SparkSession, schema: Schema):
    return spark.read.schema(schema) if schema is not None else spark.read


def json_array(spark: SparkSession, path: str | list[str], schema: Schema = None) -> DataFrame:
    """Files that each hold one array of objects; .gz too. A file isn't split, so large corpora come as lines."""
    return _reader(spark, schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str | list[str], schema: Schema = None) -> DataFrame:
    return _reader(spark, schema).json(path)


def keyed(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """An index: of rows with one key the last in order; aggregated before the shuffle."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("__row")
    return rows.groupBy(key).agg(last).select(key, "__row.*")


def delimited(spark: SparkSession, path: str | list[str], names: list[str], tab: bool = False, header: bool = True) -> DataFrame:
    """Columns by position under given names, as text; quoted fields may hold line ends."""
    rows = spark.read.csv(path, header=header, sep="\t" if tab else ",", multiLine=True, escape='"')
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns, names, strict=False)])


def with_sidecar(spark: SparkSession, parquet: str, sidecar: str, key: str, schema: Schema = None) -> DataFrame:
    """Parquet rows with the fields of their JSON lines."""
    return spark.read.parquet(parquet).join(json_lines(spark, sidecar, schema), key)


def episodes(spark: SparkSession, path: str | list[str], schema: Schema = None) -> DataFrame:
    """One JSON file an episode; its name is the column `episode`."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.json(?:\.gz)?$", 1)
    return _reader(spark, schema).json(path, multiLine=True).select("*", name.alias("episode"))


def whole_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and text of html or XML files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def repaired_xml(text: Column) -> Column:
    """XML whose bare & are escaped and whose control characters are gone."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)", "&amp;")


def xml_nodes(spark: SparkSession, path: str | list[str], tag: str, schema: Schema = None) -> DataFrame:
    return _reader(spark, schema).format("xml").option("rowTag", tag).load(path)


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Sources one after another; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def of_split(rows: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """Rows of a split's ids; whether these are broadcast is up to their measured size."""
    return rows.join(split.select(key), key, "left_semi")


def string_list(text: Column, kind: str = "array<double>") -> Column:
    """A list written as text, with either quotes or tuples; null if it is none. Never evaluated."""
    return F.from_json(F.translate(text, "()'", '[]"'), kind)


def _number(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("int")


def image_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, width and height of PNG and GIF files by their headers; null for other files."""
    rows = spark.read.format("binaryFile").load(path)
    c = F.col("content")
    png, gif = F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A", F.hex(F.substring(c, 1, 4)) == "47494638"

    def little(at: int) -> Column:
        return _number(c, at, 1) + 256 * _number(c, at + 1, 1)

    return rows.select("path", F.when(png, _number(c, 16, 4)).when(gif, little(6)).alias("width"), F.when(png, _number(c, 20, 4)).when(gif, little(8)).alias("height"))


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, position and payload of length-prefixed record files, gzipped or not.

    A record is its length (8 bytes, little endian), 4 bytes of checksum, the payload and 4
    more. A file cut short ends with its last whole record.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = raw.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                at, k, out, held = 0, 0, [], 0
                while at + 16 <= len(data):
                    n = struct.unpack_from("<Q", data, at)[0]
                    if at + 16 + n > len(data):
                        break
                    out.append((k, data[at + 12 : at + 12 + n]))
                    at, k, held = at + 16 + n, k + 1, held + n
                    if held > 4 << 20:
                        yield _rows(name, out)
                        out, held = [], 0
                if out:
                    yield _rows(name, out)

    return files.mapInArrow(run, "path string, position long, payload binary")


def _rows(name: str, out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array([k for k, _ in out], pa.int64()), pa.array([p for _, p in out], pa.binary())], ["path", "position", "payload"])
