"""Image files in strips as a source, and one SVG file for each image as a sink, by Spark's Python data source API.

``register(spark)``, then ``spark.read.format("raster").load(folder)`` and
``results.write.format("svgfile").mode("append").save(folder)``. Both reach paths and URIs by Arrow's
file systems, so the folder has to be one that all executors reach by the same name; images in
formats that the JVM decodes are read by ``sources.raster.decode_images``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rasterloom.functions.workers import reach_workers
from rasterloom.sources.raster import PIXEL

#: Rows of pixels in a strip hold about so many pixels.
STRIP_PIXELS = 1 << 18
#: Bytes in which the header of a file has to end.
HEADER_BYTES = 4096
HEADER = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s+(?:#[^\n]*\n\s*)*(\d+)\s")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Strip(InputPartition):
    """Rows of pixels of one file, from its byte ``offset`` on."""

    path: str
    image_id: int
    width: int
    height: int
    channels: int
    offset: int
    first: int
    rows: int


class StripReader(DataSourceReader):
    """Plans strips from the headers of files; a task reads its strip's bytes alone."""

    def __init__(self, options: dict):
        self.path, self.strip = options["path"], int(options.get("strippixels", STRIP_PIXELS))

    def partitions(self) -> list[Strip]:
        system, root = _place(self.path)
        info = system.get_file_info(root)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((x for x in found if x.is_file and x.extension in ("ppm", "pgm", "pnm")), key=lambda x: x.path):
            with system.open_input_file(f.path) as file:
                m = HEADER.match(file.read(HEADER_BYTES))
            if not m or int(m[4]) != 255:
                raise ValueError(f"{f.path} has no header of 8-bit raw pixels")
            w, h, channels = int(m[2]), int(m[3]), 3 if m[1] == b"6" else 1
            if f.size < m.end() + w * h * channels:
                raise ValueError(f"{f.path} ends before its last pixel")
            image, step = xxhash.xxh64_intdigest(f.path) - (1 << 63), max(1, self.strip // w)
            out += [Strip(f.path, image, w, h, channels, m.end() + y * w * channels, y, min(step, h - y)) for y in range(0, h, step)]
        return out

    def read(self, strip: Strip | None) -> Iterator[pa.RecordBatch]:
        if strip is None:  # there are no files
            return
        system, _ = _place(self.path)
        with system.open_input_file(strip.path) as file:
            file.seek(strip.offset)
            data = file.read(strip.rows * strip.width * strip.channels)
        px = np.frombuffer(data, dtype=np.uint8).reshape(strip.rows, strip.width, strip.channels).astype(np.int32)
        for i in range(strip.rows):
            n = strip.width
            same = lambda v, kind=np.int32: np.full(n, v, dtype=kind)  # noqa: B023, E731
            colours = [np.ascontiguousarray(px[i, :, c % strip.channels]) for c in range(3)]
            columns = [same(strip.image_id, np.int64), same(n), same(strip.height), same(strip.first + i), np.arange(n, dtype=np.int32), *colours]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(PIXEL))


class RasterFiles(DataSource):
    """Pixels of the binary PPM and PGM files of a folder; options: path, stripPixels."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "image_id long, " + ", ".join(f"{c} int" for c in PIXEL[1:])

    def reader(self, schema) -> StripReader:
        return StripReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    """Names of the files that a task wrote."""

    names: list


class SvgWriter(DataSourceWriter):
    """Tasks write into a folder of the job's own; files get their names when all tasks are done, and go if one fails."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns, self.job = options["path"], columns, uuid.uuid4().hex
        if not {"image_id", "svg"} <= set(columns):
            raise ValueError("rows need the columns image_id and svg")

    def _pending(self, root: str) -> str:
        return f"{root}/_pending-{self.job}"

    def write(self, rows: Iterator) -> Written:
        system, root = _place(self.path)
        folder, names = f"{self._pending(root)}/{uuid.uuid4().hex}", []  # an attempt's own, so that a second one is not mixed with it
        system.create_dir(folder, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{folder}/{r['image_id']}.svg") as out:
                out.write((r["svg"] or "").encode())
            names.append(f"{folder}/{r['image_id']}.svg")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _place(self.path)
        for m in messages:
            for name in m.names if m else ():
                system.move(name, f"{root}/{name.rsplit('/', 1)[1]}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            system.delete_dir(self._pending(root))


class SvgFiles(DataSource):
    """A file ``<image_id>.svg`` for each row (image_id, svg); a later row of an id replaces its file."""

    @classmethod
    def name(cls) -> str:
        return "svgfile"

    def writer(self, schema, overwrite: bool) -> SvgWriter:
        return SvgWriter(self.options, schema.names)


def register(spark: SparkSession) -> None:
    reach_workers(spark)
    for source in (RasterFiles, SvgFiles):
        spark.dataSource.register(source)
