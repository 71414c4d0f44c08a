"""Videos as a data source: one row a frame, read where the task runs, and a sink that writes them.

The scan lists the files of some folders by name alone; each task opens its own files through a *codec* and seeks the frames
that are asked for, so no byte of a video passes an exchange or the driver, and with 25 frames wanted 25 are decoded.
Small files share a partition; with all frames wanted, a large one is read in several runs of frames by different tasks.
A file that can't be opened, breaks off or is too short gives one row with an ``error`` instead of frames.

A codec is any object with ``open(file)``, which returns a clip or raises, and ``encode(frames, height, width, channels)``, which the sink
needs only.  A clip has ``n_frames``, ``height``, ``width``, ``channels`` and ``read(places)``, an iterator of the frames' bytes.
``RawCodec`` stores frames as they are.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

FRAME = "video_id string, path string, frame_idx int, given int, place int, n_frames int, height int, width int, channels int, px binary, error string"
_TYPES = [("video_id", pa.string()), ("path", pa.string()), *((c, pa.int32()) for c in ("frame_idx", "given", "place", "n_frames", "height", "width", "channels")), ("px", pa.binary()), ("error", pa.string())]
CLIP = "video_id string, frames array<binary>, height int, width int, channels int"
#: Frames that a video has at least.
LEAST = 25
#: Bytes of files in a partition, of pixels in a batch; what opening a file counts as.
PARTITION_BYTES, BATCH_BYTES, OPEN_BYTES = 128 << 20, 8 << 20, 256 << 10


class RawCodec:
    """Four numbers (frames, height, width, channels) after a mark, then the pixels."""

    MARK = b"RAWCLIP1"

    @dataclass
    class Clip:
        file: object
        n_frames: int
        height: int
        width: int
        channels: int

        def read(self, places: list[int]) -> Iterator[bytes]:
            size = self.height * self.width * self.channels
            for i in places:
                self.file.seek(24 + i * size)
                px = self.file.read(size)
                if len(px) < size:
                    raise ValueError(f"frame {i} breaks off")
                yield px

    def open(self, file) -> RawCodec.Clip:
        head = file.read(24)
        if len(head) < 24 or head[:8] != self.MARK:
            raise ValueError("not a raw clip")
        return self.Clip(file, *struct.unpack("<4I", head[8:]))

    def encode(self, frames: list[bytes], height: int, width: int, channels: int) -> bytes:
        return self.MARK + struct.pack("<4I", len(frames), height, width, channels) + b"".join(frames)


def places(total: int, n: int | None) -> list[int]:
    """``n`` places spread evenly over ``total`` frames, or all."""
    if n is None:
        return list(range(total))
    if n == 1:
        return [0]
    return [i * (total - 1) // (n - 1) for i in range(n)]


@dataclass
class Run(InputPartition):
    """Files, each with which of how many equal runs of its frames."""

    files: list[tuple[str, int, int]]


class FrameReader(DataSourceReader):
    def __init__(self, codec, folders: list[str], suffix: str, frames: int | None, pixels: bool, least: int, partition_bytes: int, tasks: int = 1) -> None:
        self.codec, self.folders, self.suffix, self.frames, self.pixels, self.least, self.partition_bytes, self.tasks = codec, folders, suffix, frames, pixels, least, partition_bytes, tasks
        self.only: set[str] | None = None

    def listed(self) -> Iterator[tuple[str, int]]:
        """Path and size of the files right in each folder, by name."""
        from pyarrow import fs

        for folder in self.folders:
            system, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
            prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
            for x in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda x: x.base_name):
                if x.is_file and x.base_name.endswith(self.suffix) and not x.base_name.startswith((".", "_")) and (self.only is None or _stem(x.path, self.suffix) in self.only):
                    yield prefix + x.path, x.size or 0

    def partitions(self) -> list[Run]:
        """Files are put together up to ``partition_bytes``, or less where there would be fewer than ``tasks`` partitions.

        To open a file takes time too, so each counts as ``OPEN_BYTES`` more, and of very many small ones no task gets them all.
        """
        listed = list(self.listed())
        cost = sum(n + OPEN_BYTES for _, n in listed)
        room = min(self.partition_bytes, -(-cost // self.tasks)) if self.tasks > 1 else self.partition_bytes
        out, held, size = [], [], 0
        for path, n in listed:
            # what is sampled reads little of a file, however long
            runs = 1 if self.frames is not None or not self.pixels else max(1, -(-n // self.partition_bytes))
            for k in range(runs):
                more = n // runs + OPEN_BYTES
                if held and size + more > max(room, OPEN_BYTES):
                    out.append(Run(held))
                    held, size = [], 0
                held.append((path, k, runs))
                size += more
        return [*out, Run(held)] if held or not out else out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, k, runs in partition.files:
            for row in self._rows(path, k, runs):
                rows.append(row)
                size += len(row[-2] or b"") + 200
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _rows(self, path: str, k: int, runs: int) -> Iterator[tuple]:
        from pyarrow import fs

        name, opened = _stem(path, self.suffix), False
        try:
            system, root = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
            with system.open_input_file(root) as file:
                clip = self.codec.open(file)
                shape = clip.n_frames, clip.height, clip.width, clip.channels
                if clip.n_frames < self.least:
                    raise ValueError(f"{clip.n_frames} frames, {self.least} are needed")
                opened = True
                if not self.pixels:
                    yield (name, path, 0, 1, 0, *shape, None, None)
                    return
                wanted = places(clip.n_frames, self.frames)
                first, end = k * len(wanted) // runs, (k + 1) * len(wanted) // runs
                found = ((name, path, i, len(wanted), wanted[i], *shape, px, None) for i, px in zip(range(first, end), clip.read(wanted[first:end]), strict=True))
                yield from found if self.frames is None else list(found)  # a few frames are all there before one is given
        except Exception as e:  # whatever a codec raises; a file's failure is data here, not the job's
            if opened or k == 0:  # what keeps a file from being opened is said once
                yield (name, path, -1, *[None] * (len(_TYPES) - 4), str(e) or type(e).__name__)


class FilteringReader(FrameReader):
    """For sessions where ``spark.sql.python.filterPushdown.enabled`` is set; Spark refuses it elsewhere."""

    def pushFilters(self, filters):
        """Files whose name a filter rules out aren't opened."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("video_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
            yield f


def _stem(path: str, suffix: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(suffix)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _TYPES, strict=True)], [n for n, _ in _TYPES])


class ClipWriter(DataSourceArrowWriter):
    """Each clip to a file of its own: under another name first, so that a task that is run again or lost leaves whole files only."""

    def __init__(self, codec, folder: str, suffix: str) -> None:
        self.codec, self.folder, self.suffix = codec, folder, suffix

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (fs.LocalFileSystem(), self.folder)
        system.create_dir(root)
        for b in iterator:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                aside = f"{root}/.{row['video_id']}.{uuid.uuid4().hex}"
                with system.open_output_stream(aside) as out:
                    out.write(self.codec.encode(row["frames"], row["height"], row["width"], row["channels"]))
                system.move(aside, f"{root}/{row['video_id']}{self.suffix}")
        return WriterCommitMessage()


class Videos(DataSource):
    """Options: ``path`` (a folder or a JSON list of some), ``suffix``, ``frames`` (how many, evenly spread; all if left out), ``pixels`` (false: one row a video, its head alone), ``least``, ``partitionBytes``, ``tasks`` (partitions that many files are dealt out to at least)."""

    codec: object = RawCodec()

    @classmethod
    def name(cls) -> str:
        return "videos"

    def schema(self) -> str:
        return FRAME

    def _folders(self) -> list[str]:
        path = self.options["path"]
        return [x.rstrip("/") for x in (json.loads(path) if path.startswith("[") else [path])]

    def reader(self, schema) -> FrameReader:
        o = self.options
        frames = o.get("frames")
        kind = FilteringReader if o.get("filters", "false") == "true" else FrameReader
        return kind(self.codec, self._folders(), o.get("suffix", ".mp4"), None if frames is None else int(frames), o.get("pixels", "true").lower() == "true", int(o.get("least", LEAST)), int(o.get("partitionBytes", PARTITION_BYTES)), int(o.get("tasks", 1)))

    def writer(self, schema, overwrite: bool) -> ClipWriter:
        return ClipWriter(self.codec, self._folders()[0], self.options.get("suffix", ".mp4"))


def register(spark: SparkSession, codec=None, name: str = "videos") -> str:
    """Registers the data source for a codec under a name; returns that."""
    made = type("Videos_" + name, (Videos,), {"codec": codec or Videos.codec, "name": classmethod(lambda cls: name), "__module__": "__main__"})
    spark.dataSource.register(made)
    return name


def read_frames(spark: SparkSession, folders: list[str], codec=None, frames: int | None = None, pixels: bool = True, **options) -> DataFrame:
    """Rows of ``FRAME`` of all videos right in some folders.

    ``frame_idx`` counts a video's rows, of which ``given`` there are, from 0; ``place`` is the frame's number in the video. With an ``error``, -1 and nulls.
    """
    found = spark.read.format(register(spark, codec)).option("path", json.dumps(folders)).option("pixels", str(pixels).lower())
    found = found.option("tasks", 4 * spark.sparkContext.defaultParallelism)
    found = found.option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (found if frames is None else found.option("frames", frames)).options(**options).load()


def write_clips(clips: DataFrame, folder: str, codec=None, suffix: str = ".mp4") -> None:
    """Rows of ``CLIP`` as one file each; files of the same name are replaced."""
    clips.selectExpr("video_id", "frames", "height", "width", "channels").write.format(register(clips.sparkSession, codec)).mode("append").option("suffix", suffix).save(folder)
