"""Readers and sinks of trajectory tables and sidecars.

Readers give the library's schema with NaN as NULL. A folder or glob of recordings is one scan: the
recording's name comes from the file's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import int_list
from ..operators.review import latest_verdicts, without_mounts
from ..schema import CANDIDATES, DETECTION_DECIMALS, DETECTIONS, KEY, SWAP_LOG, VERDICTS, nan_to_null, require
from .scratch import spread

SIDECAR_VERSION = 1
#: Names the newest version of a folder that holds several.
POINTER = "NEWEST"
ARENA = (
    "schema_version int, video struct<path:string,sha256:string,frame_size:array<int>,fps:double>, "
    "arena struct<shape:string,geometry:string>, world_frame struct<origin_pixel:array<double>,y_axis:string,x_axis:string>, "
    "calibration struct<reference_kind:string,reference_vertices:array<array<double>>,physical_mm:double,pixel_distance:double,mm_per_pixel:double>, "
    "trim struct<start_s:double,end_s:double>"
)
ROIS = "schema_version int, mode string, rois array<struct<operation:string,label:string,shape:string,geometry:string>>"


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns by name in any order; those that the file lacks are NULL. A recording is named by its column, else by its file."""
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]
    header = spark.read.option("header", True).csv(newest(spark, path))
    kinds = dict(f.strip().split(" ", 1) for f in schema.split(", "))
    cols = [F.col(f"`{n}`").try_cast(kinds[n]).alias(n) if n in header.columns else F.lit(None).cast(kinds[n]).alias(n) for n in names]
    others = [c for c in header.columns if c not in (*names, "recording_id")]
    name = F.col("recording_id") if "recording_id" in header.columns else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^/]*)?$", 1)
    return nan_to_null(header.select(name.alias("recording_id"), *cols, *others))


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(newest(spark, path))
    require(header, *[f.split(" ")[0] for f in DETECTIONS.split(", ")])
    df = _csv(spark, path, DETECTIONS)
    return df.withColumn("roi_label", F.coalesce("roi_label", F.lit("_merged")))


def read_trajectory(spark: SparkSession, path: str, include_mount: bool = False) -> DataFrame:
    from ..schema import AUDITED

    df = _csv(spark, path, AUDITED)
    return df if include_mount else without_mounts(df)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """A missing file is an empty table."""
    return _csv(spark, path, CANDIDATES) if _there(spark, path) else spark.createDataFrame([], "recording_id string, " + CANDIDATES)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """As candidates, the last verdict of each event; ``swap`` has the permutation as numbers, NULL in files without that column."""
    df = _csv(spark, path, VERDICTS) if _there(spark, path) else spark.createDataFrame([], "recording_id string, " + VERDICTS)
    df = latest_verdicts(df.na.fill("", ["source", "reviewer", "note"]))
    return df.withColumn("swap", int_list(F.col("permutation")))


def read_swap_log(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, SWAP_LOG) if _there(spark, path) else spark.createDataFrame([], "recording_id string, " + SWAP_LOG)


def _sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    df = spark.read.schema(schema).option("multiLine", True).json(newest(spark, path))
    fine = F.coalesce(F.col("schema_version") == SIDECAR_VERSION, F.lit(False))
    checked = F.when(fine, F.col("schema_version")).otherwise(F.raise_error(F.lit("a sidecar of another version")).cast("int"))
    return df.withColumn("schema_version", checked)


def read_arena(spark: SparkSession, path: str) -> DataFrame:
    return _sidecar(spark, path, ARENA)


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    return _sidecar(spark, path, ROIS)


def read_params(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    """Tuning parameters; unknown ones are left out and missing ones have their defaults."""
    df = _sidecar(spark, path, schema)
    return df.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in df.columns])


def file_hashes(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """SHA-256 of the files at ``path``; with ``name``, of all below that folder whose names fit it, found by many tasks."""
    files = spark.read.format("binaryFile")
    files = files.options(recursiveFileLookup=True, pathGlobFilter=name) if name else files
    return files.load(path).select("path", F.sha2("content", 256).alias("sha256"))


def rounded(df: DataFrame, decimals: dict[str, int] = DETECTION_DECIMALS) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in decimals.items() if c in df.columns})


def four_places(df: DataFrame) -> DataFrame:
    """Doubles as text with four decimals, NULL staying NULL."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))) for c, t in df.dtypes if t == "double"})


def _files(spark: SparkSession, path: str):
    """The file system of a path, and its path class."""
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark._jsc.hadoopConfiguration()), to


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Point ``path`` at one of its versions: a small file that is replaced by a rename, so readers follow the old one or the new one."""
    files, to = _files(spark, path)
    part = to(f"{path}/_{uuid.uuid4().hex}")
    out = files.create(part, False)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    how = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(part, to(f"{path}/{POINTER}"), how)


def newest(spark: SparkSession, path: str) -> str:
    """The version that ``path`` points at; a path without a pointer is itself a version."""
    files, to = _files(spark, path)
    if not files.exists(to(f"{path}/{POINTER}")):
        return path
    return f"{path}/" + spark.read.text(f"{path}/{POINTER}", wholetext=True).first()["value"]


def write_csv(df: DataFrame, path: str) -> str:
    """Write a new version under ``path``, point at it, and return its folder: readers never see half a table."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.option("header", True).csv(f"{path}/{version}")
    publish(df.sparkSession, path, version)
    return f"{path}/{version}"


def by_track(df: DataFrame) -> DataFrame:
    """The order of sinks: recording, track, frame."""
    return df.orderBy("recording_id", "track_id", "frame_idx")


def write_detections(df: DataFrame, path: str) -> str:
    return write_csv(by_track(rounded(df.select("recording_id", *[f.split(" ")[0] for f in DETECTIONS.split(", ")]))), path)


def write_series(df: DataFrame, path: str) -> str:
    """A table of frames with a column for each track or pair, in the order of frames."""
    return write_csv(four_places(df.orderBy("recording_id", "frame_idx")), path)


def write_trajectory(df: DataFrame, path: str, schema: str) -> str:
    """The schema's columns in order, those that are missing as NULL, then any others."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    known = [F.col(n) if n in df.columns else F.lit(None).cast("double").alias(n) for n in names]
    others = [c for c in df.columns if c not in names and c not in KEY[:1]]
    return write_csv(four_places(by_track(df.select("recording_id", *known, *others))), path)


def write_events(df: DataFrame, path: str) -> str:
    """Candidates or verdicts in the order of start frame and, as text, event id."""
    flat = df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith("array")})
    return write_csv(flat.orderBy("frame_start", "event_id"), path)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The background table at ``path``; made by ``build`` and written there if it is missing or ``force`` asks for it."""
    if force or not _there(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_fingerprints(df: DataFrame, path: str) -> str:
    """A new version by recording, rows in the order of frames and tracks."""
    version = f"v-{uuid.uuid4().hex}"
    order = [c for c in ("recording_id", "frame_idx", "track_id") if c in df.columns]
    df.sortWithinPartitions(*order).write.partitionBy("recording_id").option("compression", "zstd").parquet(f"{path}/{version}")
    publish(df.sparkSession, path, version)
    return f"{path}/{version}"


def read_fingerprints(spark: SparkSession, path: str, recordings: list[str] | None = None) -> DataFrame:
    """The newest fingerprints, of some recordings only if they are named: other folders aren't read. Ids stay text."""
    known = spark.read.option("basePath", newest(spark, path)).parquet(newest(spark, path)).withColumn("recording_id", F.col("recording_id").cast("string"))
    return known if recordings is None else known.filter(F.col("recording_id").isin(recordings))


def write_json(df: DataFrame, path: str) -> str:
    """A new version with a file for each row; making files is what takes time, so all cores share it."""
    version = f"v-{uuid.uuid4().hex}"
    spread(df).write.option("maxRecordsPerFile", 1).json(f"{path}/{version}")
    publish(df.sparkSession, path, version)
    return f"{path}/{version}"
