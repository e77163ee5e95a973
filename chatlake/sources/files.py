"""Files to ``path, source, text`` rows: plain text, bytes and zip archives of text."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("txt", "md", "log")


def source_name(path: Column) -> Column:
    """The file's stem without what chat exports put around it."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    clean = F.trim(F.replace(F.replace(stem, F.lit("WhatsApp Chat - "), F.lit("")), F.lit("_chat"), F.lit("")))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("kaynak"))


def decoded(content: Column) -> Column:
    """UTF-8, bad bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, source, content`` of the text files and archives in a folder, whole; an absent folder gives no row."""
    schema = "path string, source string, content binary"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,md,log,zip}").load(folder)
    return found.select("path", source_name(F.col("path")).alias("source"), "content")


#: What a damaged or encrypted archive raises.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError)


def _entries(row: dict) -> Iterator[dict]:
    """Text entries of an archive, one at a time; media are never opened."""
    with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
        for name in z.namelist():
            stem, _, suffix = name.rpartition("/")[2].rpartition(".")
            if suffix.lower() in SUFFIXES:
                source = row["source"] if stem == "_chat" else f"{row['source']}-{stem}"
                yield {"path": f"{row['path']}!{name}", "source": source, "content": z.read(name)}


def _archives(files: DataFrame, keep_errors: bool) -> DataFrame:
    kind = pa.schema([("path", pa.string()), ("source", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    for entry in _entries(row):
                        yield pa.RecordBatch.from_pylist([entry | {"error": None}], schema=kind)
                except BROKEN as e:
                    if not keep_errors:
                        raise ValueError(f"cannot read the archive {row['path']}") from e
                    yield pa.RecordBatch.from_pylist([{"path": row["path"], "source": row["source"], "content": None, "error": type(e).__name__}], schema=kind)

    return files.where(F.lower("path").endswith(".zip")).mapInArrow(run, "path string, source string, content binary, error string")


def expanded(files: DataFrame, strict: bool = True) -> DataFrame:
    """Archives replaced by their text entries; the one step that Spark has no reader for.

    A damaged archive is an error that names it. With ``strict`` false its entries before the damage stay; :func:`broken_archives` lists it.
    """
    inside = _archives(files, not strict).where("error is null").drop("error")
    return files.where(~F.lower("path").endswith(".zip")).unionByName(inside)


def broken_archives(files: DataFrame) -> DataFrame:
    """``path, error`` of the archives that cannot be read to their end."""
    return _archives(files, True).where("error is not null").select("path", "error")


def texts(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """``path, source, text`` of all text in a folder."""
    return expanded(text_files(spark, folder), strict).select("path", "source", decoded(F.col("content")).alias("text"))


def distinct_files(files: DataFrame, position: str = "path") -> DataFrame:
    """One file for each content, the first by ``position``, with its ``sha256``."""
    hashed = files.withColumn("sha256", F.sha2("content", 256))
    # min() is combined before the shuffle, so a content with very many copies costs one row for each task.
    first = hashed.groupBy("sha256").agg(F.min(position).alias(position))
    return hashed.join(first, ["sha256", position], "left_semi")
