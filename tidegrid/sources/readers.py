"""Readers and writers of survey data: metadata, soundings, areas, tiles and shapes.

All read through Spark, so any store that Spark reads will do.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import coords

METADATA = "`CDI-record id` long, `LOCAL_CDI_ID` string, `Data Set name` string, `Datum` string, `Latitude 1` double, `Latitude 2` double, `Longitude 1` double, `Longitude 2` double, `Start Date` int, `End Date` int, `rejected` int, `point_density(100x100m)` double"
#: Surveys that are rejected by hand.
REJECTED = (2174832, 3455421)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Surveys of a CSV file with a header; columns are matched by name."""
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: f.dataType for f in _parse_datatype_string(METADATA)}
    df = spark.read.csv(path, header=True)
    df = df.select(*(F.col(f"`{c}`").cast(kinds.get(c, "string")).alias(c) for c in df.columns))
    day = lambda c: F.to_date(F.col(c).cast("string"), "yyyyMMdd")
    return df.select(
        F.col("CDI-record id").alias("cdi"), F.col("LOCAL_CDI_ID").alias("local_id"), F.col("Datum").alias("datum"), day("Start Date").alias("start_date"),
        day("End Date").alias("end_date"), F.year(day("Start Date")).alias("year"), F.col("rejected"), F.col("`point_density(100x100m)`").alias("density"),
    )


def with_rejected(df: DataFrame, ids: tuple[int, ...] = REJECTED) -> DataFrame:
    return df.withColumn("rejected", F.col("cdi").isin(*ids).cast("int"))


def file_name(local_id) -> Column:
    """Name of the file with a survey's soundings."""
    return F.concat(F.lit("000574_XYZ_"), F.replace(F.replace(local_id, F.lit("/"), F.lit("_")), F.lit("v"), F.lit("V")), F.lit(".txt"))


def _fields(line: str) -> Column:
    """Parts of a line, cut at tabs if it has one, else at spaces outside quotes."""
    return F.when(F.col(line).contains("\t"), F.split(line, "\t")).otherwise(F.regexp_extract_all(line, F.lit('("[^"]*"|[^ ]+)'), F.lit(1)))


def headers(spark: SparkSession, path: str, files: Column | None = None) -> DataFrame:
    """file, fields, value: the first line of each file, its parts and the line itself; `files` as for any_soundings()."""
    first = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = first.where(F.lit(True) if files is None else files).where("at = 0").withColumn("i", F.monotonically_increasing_id())
    first = first.groupBy("file").agg(F.min_by("value", "i").alias("value"))
    return first.select("file", F.transform(_fields("value"), lambda x: F.regexp_replace(x, '^"|"$', "")).alias("fields"), "value")


# Column names in the files.
NAMES = {"Lat (DMS)": "lat_text", "Long (DMS)": "lon_text", "Northing": "northing", "Easting": "easting", "Mean": "depth", "Mean (m)": "depth"}


def soundings(spark: SparkSession, path: str, tab: bool, surveys: DataFrame | None = None) -> DataFrame:
    """file, seq, lat, lon, e, n, depth of text files of one delimiter, whichever of the two sets of columns they have.

    Degrees come from the DMS columns if there are any, else from northing and easting by the datum of `surveys`
    (local_id, datum); positions are then put into zone 31. Files of no survey are left out.
    """
    df = spark.read.option("enforceSchema", False).csv(path, header=True, sep="\t" if tab else " ")
    df = df.select(*(F.col(f"`{c}`").alias(NAMES[c]) for c in df.columns if c in NAMES), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("seq"))
    for c in set(NAMES.values()) - set(df.columns):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return _placed(df, surveys)


def any_soundings(spark: SparkSession, path: str, surveys: DataFrame | None = None, files: Column | None = None) -> DataFrame:
    """As soundings(), of files of either delimiter and either set of columns side by side: each file's first line tells. Names and
    values may stand in quotes; lines with fewer values than names end in nulls.

    `files`: a condition on `file`, the file's name; files that don't meet it are never opened, as Spark prunes them when it lists
    the folder. Lines are split where they are read, and files may be split over tasks.
    """
    kept = F.lit(True) if files is None else files
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(kept).withColumn("seq", F.monotonically_increasing_id())
    heads = headers(spark, path, files).select(F.col("file").alias("_file"), "fields", "value")
    fields = lambda v: F.transform(_fields(v), lambda x: F.regexp_replace(x, '^"|"$', ""))
    rows = lines.join(heads.withColumnRenamed("value", "_head"), F.col("file") == F.col("_file")).where("value <> _head AND trim(value) <> ''")
    rows = rows.select("file", "seq", "fields", fields("value").alias("_v"))
    # the value under each of a name's spellings; 0 is no such name
    under = lambda name: F.get("_v", F.nullif(F.array_position("fields", F.lit(name)), F.lit(0)).cast("int") - 1)
    columns = {n: F.coalesce(*(under(k) for k, v in NAMES.items() if v == n)) for n in dict.fromkeys(NAMES.values())}
    return _placed(rows.select("file", "seq", *(c.alias(n) for n, c in columns.items())), surveys)


def _placed(df: DataFrame, surveys: DataFrame | None) -> DataFrame:
    """Degrees and positions in zone 31 of rows with the columns of NAMES."""
    lat, lon = coords.dms(F.col("lat_text")), coords.dms(F.col("lon_text"))
    if surveys is not None:
        s = surveys.select(file_name(F.col("local_id")).alias("file"), "datum")
        df = df.join(s, "file")
        by_datum = coords.to_degrees(F.col("datum"), F.col("northing").cast("double"), F.col("easting").cast("double"))
        plain = F.col("northing").isNotNull()
        lat, lon = F.coalesce(lat, F.when(plain, by_datum[0])), F.coalesce(lon, F.when(plain, by_datum[1]))
    df = df.select("file", "seq", lat.alias("lat"), lon.alias("lon"), F.col("depth").cast("double").alias("depth"))
    e, n = coords.utm_forward(F.col("lat"), F.col("lon"))
    return df.withColumns({"e": e, "n": n}).where("lat IS NOT NULL AND lon IS NOT NULL")


def area(spark: SparkSession, path: str) -> DataFrame:
    """seq, x, y of a text file with a position a line, decimal commas."""
    line = F.split(F.replace(F.trim("value"), F.lit(","), F.lit(".")), r"\s+")
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("seq", "value")).where("trim(value) <> ''")
    return t.select("seq", line[0].cast("double").alias("x"), line[1].cast("double").alias("y"))


def npy_tiles(spark: SparkSession, path: str, which: Column | None = None) -> DataFrame:
    """cell, cdi, h, w, data of .npy files named cell_<cell>_..._<cdi>[_...].npy; NaN is NULL.

    `which`: a condition on cell and cdi. Both are in the files' names, so Spark prunes the others when it lists the folder: they are
    never opened. A condition on the result would come after reading."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                a = np.load(io.BytesIO(content.as_py()), allow_pickle=False).astype(float)
                parts = name.rsplit(".", 1)[0].split("_")
                data = pa.array(a.ravel(), mask=~np.isfinite(a.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(parts[1])], pa.int32()), pa.array([int(parts[3])], pa.int64()), pa.array([a.shape[0]], pa.int32()), pa.array([a.shape[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), data)],
                    ["cell", "cdi", "h", "w", "data"],
                )

    part = lambda i: F.split(F.substring_index("_metadata.file_name", ".", 1), "_")[i]
    files = spark.read.format("binaryFile").load(path)
    if which is not None:
        files = files.select("content", F.col("_metadata.file_name").alias("name"), part(1).cast("int").alias("cell"), part(3).cast("long").alias("cdi")).where(which)
    else:
        files = files.select("content", F.col("_metadata.file_name").alias("name"))
    return files.select("name", "content").mapInArrow(load, "cell int, cdi long, h int, w int, data array<double>")


def shapes(spark: SparkSession, path: str) -> DataFrame:
    """file, id, part, seq, x, y: vertices of the lines and polygons of .shp files."""

    def vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, at = content.as_py(), 100
                while at < len(raw):
                    number, half = struct.unpack(">ii", raw[at : at + 8])
                    body = raw[at + 8 : at + 8 + 2 * half]
                    at += 8 + 2 * half
                    if struct.unpack("<i", body[:4])[0] not in (3, 5, 13, 15, 23, 25):
                        continue
                    n_parts, n = struct.unpack("<ii", body[36:44])
                    starts = np.frombuffer(body, "<i4", n_parts, 44)
                    xy = np.frombuffer(body, "<f8", 2 * n, 44 + 4 * n_parts).reshape(-1, 2)
                    part = np.searchsorted(starts, np.arange(n), side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(np.full(n, number, np.int64)), pa.array(part.astype(np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())],
                        ["file", "id", "part", "seq", "x", "y"],
                    )

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(vertices, "file string, id long, part int, seq int, x double, y double")


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header, a file a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tiles(pixels: DataFrame, path: str) -> None:
    """Pixels as Parquet, a folder a cell, so that a read of some cells skips the others."""
    pixels.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
