"""A data source of frames stored as one raw grey file a recording: ``<name>_<width>x<height>.gray``.

Files are listed and read through Arrow's file systems, so paths may name local folders or remote stores. Each
partition reads a range of frames by seeking, so a long recording is read by many tasks; start, end, every and
filters on ``frame_idx`` leave only the frames that are asked for. As a stream the source follows files that
grow or come: its offset is the number of whole frames of each.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
from collections.abc import Iterable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

NAME = re.compile(r"(.+)_(\d+)x(\d+)\.gray$")


class FrameRange(InputPartition):
    """Frames of one file; ``only`` lists them, else they run from ``lo`` to ``hi`` by ``every`` from ``start``."""

    def __init__(self, path: str, frames: list[int]):
        self.path, self.frames = path, frames


def _split(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def totals(pattern: str) -> dict[str, int]:
    """Whole frames of each file that matches."""
    system, path = _split(pattern)
    found = system.get_file_info(fs.FileSelector(posixpath.dirname(path) or ".", allow_not_found=True))
    out = {}
    for info in sorted(found, key=lambda i: i.path):
        if info.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(info.path), posixpath.basename(path)):
            m = NAME.match(posixpath.basename(info.path))
            if not m:
                raise ValueError(f"{info.path} isn't named <name>_<width>x<height>.gray")
            out[info.path] = info.size // (int(m[2]) * int(m[3]))
    return out


class _Reading:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"]
        self.start, self.every = int(options.get("start", 0)), int(options.get("every", 1))
        self.end = int(options["end"]) if "end" in options else None
        self.step = int(options.get("framesPerPartition", 1000))
        if self.start < 0 or self.every < 1 or (self.end is not None and self.end <= self.start):
            raise ValueError("start, end and every name no frames")

    def ranges(self, path: str, lo: int, hi: int, wanted: set[int] | None = None) -> list[FrameRange]:
        hi = hi if self.end is None else min(hi, self.end)
        first = max(lo, self.start)
        first += (self.start - first) % self.every
        frames = range(first, hi, self.every)
        if wanted is not None:
            frames = [i for i in sorted(wanted) if i in frames]
        return [FrameRange(path, frames[k : k + self.step]) for k in range(0, len(frames), self.step)]

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        if not partition.path:
            return
        m = NAME.match(posixpath.basename(partition.path))
        width, height = int(m[2]), int(m[3])
        with _split(self.pattern)[0].open_input_file(partition.path) as f:
            for i in partition.frames:
                yield m[1], i, width, height, f.read_at(width * height, i * width * height)


class FrameReader(_Reading, DataSourceReader):
    """Filters that compare ``frame_idx`` with numbers narrow what is read; Spark applies them again."""

    wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_idx",):
                if isinstance(f, (EqualTo, In)):
                    values = set(f.value) if isinstance(f, In) else {f.value}
                    self.wanted = values if self.wanted is None else self.wanted & values
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    end = f.value + isinstance(f, LessThanOrEqual)
                    self.end = end if self.end is None else min(self.end, end)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    lo = f.value + isinstance(f, GreaterThan)
                    self.start += max(0, -(-(lo - self.start) // self.every)) * self.every
            yield f

    def partitions(self) -> list[FrameRange]:
        out = [r for path, n in totals(self.pattern).items() for r in self.ranges(path, 0, n, self.wanted)]
        return out or [FrameRange("", [])]


class FrameStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"frames": "{}"}

    def latestOffset(self) -> dict:
        return {"frames": json.dumps(totals(self.pattern))}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        known = json.loads(start["frames"])
        return [r for path, n in json.loads(end["frames"]).items() for r in self.ranges(path, known.get(path, 0), n)]


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grayframes"

    def schema(self) -> str:
        return "recording_id string, frame_idx bigint, width int, height int, gray binary"

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``grayframes`` known to ``spark.read`` and ``spark.readStream``, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Frames)


def probe(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and number of frames of each file, from names and lengths alone: recording_id, width, height, n_frames."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)_(\d+)x(\d+)\.gray$", 0).alias("name"), "length")
    part = lambda k: F.regexp_extract("name", NAME.pattern, k)
    known = files.filter("name <> ''").select(part(1).alias("recording_id"), part(2).cast("int").alias("width"), part(3).cast("int").alias("height"), "length")
    return known.select("recording_id", "width", "height", F.floor(F.col("length") / (F.col("width") * F.col("height"))).alias("n_frames"))


def grey_values(frames: DataFrame) -> DataFrame:
    """Pixel table of frames as bytes: recording_id, frame_idx, y, x, v."""
    byte = lambda i: F.conv(F.hex(F.substring("gray", i, 1)), 16, 10).cast("int")
    px = frames.select("recording_id", "frame_idx", "width", "gray", F.explode(F.sequence(F.lit(0), F.octet_length("gray") - 1)).alias("pos"))
    return px.select("recording_id", "frame_idx", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).alias("x"), byte(F.col("pos") + 1).alias("v"))
