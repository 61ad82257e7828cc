"""PLY files: header rules, a Python data source that scans them, and a writer of one file per partition.

Unlike line-based readers of native order, the header's byte order is honoured.
"""

from __future__ import annotations

import itertools
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from pointweave.functions.columns import frame_number

#: Element types, their struct letters, and the vocabulary of properties.
KINDS = {
    "char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H",
    "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d", "int64": "q", "uint64": "Q",
}
NAMES = {"x": "x", "y": "y", "z": "z", "red": "r", "r": "r", "green": "g", "g": "g", "blue": "b", "b": "b", "reflectance": "refl", "refl": "refl", "refc": "refl"}
WRITTEN = {c: (c, "float64", "d") for c in "xyz"} | {"r": ("red", "uchar", "B"), "g": ("green", "uchar", "B"), "b": ("blue", "uchar", "B"), "refl": ("reflectance", "int16", "h")}
#: Rows of a batch, and the most bytes of a header.
BATCH, HEAD = 65_536, 1 << 16
TYPES = {"x": "double", "y": "double", "z": "double", "r": "short", "g": "short", "b": "short", "refl": "short"}


@dataclass
class Header:
    encoding: str
    count: int
    properties: list[tuple[str, str]]
    size: int

    def columns(self) -> list[str]:
        """Known columns in fixed order; colour only with all three channels."""
        known = {NAMES[n] for n, _ in self.properties if n in NAMES}
        if not {"x", "y", "z"} <= known:
            raise ValueError("a PLY vertex needs x, y and z")
        if not {"r", "g", "b"} <= known:
            known -= {"r", "g", "b"}
        return [c for c in TYPES if c in known]


def parse_header(data: bytes) -> Header:
    encoding, count, properties, at, element, first = "", -1, [], 0, "", True
    while True:
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("PLY header without end_header")
        words = data[at:end].decode("latin-1").split()
        at = end + 1
        if first:
            if words != ["ply"]:
                raise ValueError("not a PLY file")
            first = False
        elif not words or words[0] == "comment":
            continue
        elif words[0] == "format":
            if len(words) < 2 or not (words[1] == "ascii" or words[1].startswith("binary")):
                raise ValueError("unknown PLY format")
            encoding = words[1]
        elif words[0] == "element":
            if len(words) != 3 or words[1] not in ("vertex", "face"):
                raise ValueError("unknown PLY element")
            element = words[1]
            count = int(words[2]) if element == "vertex" else count
        elif words[0] == "property":
            if element == "vertex":
                if len(words) != 3 or words[1] not in KINDS:
                    raise ValueError("unknown PLY property")
                properties.append((words[2], words[1]))
        elif words[0] == "end_header":
            if count < 0 or not encoding:
                raise ValueError("PLY header without format or vertices")
            return Header(encoding, count, properties, at)
        else:
            raise ValueError(f"unknown PLY header line: {words[0]}")


def wrap_short(v: float) -> int:
    """Truncated and wrapped to 16 bits, as a narrowing cast."""
    return (int(v) + 32768) % 65536 - 32768


def rows_of(data: bytes, columns: list[str] | None = None) -> Iterator[tuple]:
    """Rows of the known columns; a short file yields what it holds."""
    header = parse_header(data)
    columns = columns or header.columns()
    at = {NAMES[n]: i for i, (n, _) in enumerate(header.properties) if n in NAMES}
    made = [(at[c], (lambda v: v & 255 if isinstance(v, int) else int(v) & 255) if c in "rgb" else wrap_short if c == "refl" else float) for c in columns]
    if header.encoding == "ascii":
        done = 0
        for line in data[header.size :].decode("latin-1").splitlines():
            if done == header.count:
                break
            words = line.split()
            if words:
                if len(words) < len(header.properties):
                    raise ValueError("PLY row with too few values")
                yield tuple(make(float(words[i]) if make is float else int(float(words[i]))) for i, make in made)
                done += 1
    else:
        order = ">" if "big" in header.encoding else "<"
        row = struct.Struct(order + "".join(KINDS[k] for _, k in header.properties))
        whole = min(header.count, (len(data) - header.size) // row.size)
        for i in range(whole):
            values = row.unpack_from(data, header.size + i * row.size)
            yield tuple(make(values[k]) for k, make in made)


def _kept(values: np.ndarray, column: str) -> np.ndarray:
    """Colour as unsigned bytes, reflectance wrapped to 16 bits, both truncated; coordinates as doubles."""
    if column in "xyz":
        return values.astype(np.float64)
    whole = values.astype(np.int64) if values.dtype.kind in "iu" else np.trunc(values).astype(np.int64)
    return ((whole & 255) if column in "rgb" else (whole + 32768) % 65536 - 32768).astype(np.int16)


def arrays_of(data: bytes, columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of at most BATCH rows at a time; a binary body is read in place, without a Python value per number."""
    header = parse_header(data)
    header.columns()
    if header.encoding == "ascii":
        rows = rows_of(data, columns)
        while part := list(itertools.islice(rows, BATCH)):
            yield [np.array(c, np.float64 if n in "xyz" else np.int16) for c, n in zip(zip(*part), columns)]
        return
    order = ">" if "big" in header.encoding else "<"
    kind = np.dtype([(f"p{i}", order + np.dtype(KINDS[k]).str[1:]) for i, (_, k) in enumerate(header.properties)])
    at = {NAMES[n]: f"p{i}" for i, (n, _) in enumerate(header.properties) if n in NAMES}
    body = np.frombuffer(data, kind, min(header.count, (len(data) - header.size) // kind.itemsize), header.size)
    for first in range(0, len(body), BATCH):
        part = body[first : first + BATCH]
        yield [_kept(part[at[c]], c) for c in columns]


def scan_ply(spark: SparkSession, path: str, geom_only: bool = False) -> DataFrame:
    """Points of the PLY files of a folder or glob on any path that Spark reads, with their file's path.

    All files need the columns of the first; geom_only reads x, y, z alone. A file is read by one task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path)
    head = files.orderBy("path").select(F.substring("content", 1, HEAD).alias("head")).first()
    if head is None:
        raise FileNotFoundError(path)
    columns = parse_header(bytes(head["head"])).columns()[: 3 if geom_only else None]

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                name, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_buffer()
                for arrays in arrays_of(memoryview(data).tobytes(), columns):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array([name] * len(arrays[0]))], names=[*columns, "path"])

    schema = ", ".join(f"{c} {TYPES[c]}" for c in columns) + ", path string"
    return files.select("path", "content").mapInArrow(run, schema)


def scan_frames(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """Points of the numbered files with first <= number < first + count, with their frame; missing numbers are skipped."""
    frame = frame_number(F.col("path"))
    return scan_ply(spark, path).withColumn("frame", frame).where((F.col("frame") >= first) & (F.col("frame") < first + count))


def header_of(count: int, columns: list[str], encoding: str) -> bytes:
    """float64 x, y, z, uchar red, green, blue, int16 reflectance."""
    lines = [f"property {WRITTEN[c][1]} {WRITTEN[c][0]}" for c in columns]
    head = ["ply", f"format {encoding} 1.0", f"element vertex {count}", *lines, "element face 0", "property list uint8 int32 vertex_index", "end_header"]
    return ("\n".join(head) + "\n").encode()


def body_of(rows: Iterator[tuple], columns: list[str], encoding: str) -> Iterator[bytes]:
    """Each row's bytes; text has six decimals."""
    if encoding == "ascii":
        for row in rows:
            yield (" ".join(f"{v:.6f}" if c in "xyz" else str(v) for v, c in zip(row, columns)) + "\n").encode()
    else:
        pack = struct.Struct((">" if "big" in encoding else "<") + "".join(WRITTEN[c][2] for c in columns)).pack
        for row in rows:
            yield pack(*row)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PlyReader(DataSourceReader):
    def __init__(self, paths: list[str], columns: list[str]):
        self.paths, self.columns = paths, columns

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        files, place = _files(partition.path)
        with files.open_input_stream(place) as f:
            data = f.read()
        for arrays in arrays_of(data, self.columns):
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array([partition.path] * len(arrays[0]))], names=[*self.columns, "path"])


@dataclass
class _Part(WriterCommitMessage):
    name: str
    rows: int


class PlyWriter(DataSourceWriter):
    """One file for each partition with rows. Files appear under their names only once all tasks are done."""

    def __init__(self, path: str, columns: list[str], encoding: str, overwrite: bool):
        self.path, self.columns, self.encoding, self.overwrite = path.rstrip("/"), columns, encoding, overwrite
        self.hidden = f"_pending-{uuid.uuid4().hex}"

    def write(self, iterator):
        count, rows = 0, (tuple(row[c] for c in self.columns) for row in iterator)
        files, place = _files(self.path)
        # The header needs the count, so the body waits in a scratch file of this task.
        with tempfile.TemporaryFile() as body:
            for piece in body_of(rows, self.columns, self.encoding):
                body.write(piece)
                count += 1
            name = f"part-{uuid.uuid4().hex}.ply"
            if count:
                body.seek(0)
                files.create_dir(f"{place}/{self.hidden}", recursive=True)
                with files.open_output_stream(f"{place}/{self.hidden}/{name}") as out:
                    out.write(header_of(count, self.columns, self.encoding))
                    while chunk := body.read(1 << 20):
                        out.write(chunk)
        return _Part(name, count)

    def commit(self, messages):
        files, place = _files(self.path)
        files.create_dir(place, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(place)):
                if old.path.endswith(".ply"):
                    files.delete_file(old.path)
        for part in messages:
            if part and part.rows:
                files.move(f"{place}/{self.hidden}/{part.name}", f"{place}/{part.name}")
        self.abort(messages)

    def abort(self, messages):
        files, place = _files(self.path)
        if files.get_file_info(f"{place}/{self.hidden}").type != fs.FileType.NotFound:
            files.delete_dir(f"{place}/{self.hidden}")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class PlyDataSource(DataSource):
    """``format("ply")`` on paths that Arrow's file systems open; scan_ply reads all that Spark itself does.

    Reading takes a file or a folder; option geom_only reads x, y, z alone. Writing takes x, y, z and any of r, g, b (all three)
    and refl by name; option encoding is ascii, binary_little_endian or binary_big_endian.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _paths(self) -> list[str]:
        path = self.options["path"]
        files, place = _files(path)
        if files.get_file_info(place).type == fs.FileType.Directory:
            found = sorted(i.path for i in files.get_file_info(fs.FileSelector(place)) if i.path.endswith(".ply"))
            root = path[: len(path) - len(place)] if path.endswith(place) else ""
            found = [root + p for p in found]
        else:
            found = [path] if files.get_file_info(place).type == fs.FileType.File else []
        if not found:
            raise FileNotFoundError(path)
        return found

    def _columns(self) -> list[str]:
        files, place = _files(self._paths()[0])
        with files.open_input_stream(place) as f:
            columns = parse_header(f.read(HEAD)).columns()
        return columns[:3] if self.options.get("geom_only", "false").lower() == "true" else columns

    def schema(self) -> str:
        return ", ".join(f"{c} {TYPES[c]}" for c in self._columns()) + ", path string"

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(self._paths(), self._columns())

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        columns = [c for c in TYPES if c in schema.fieldNames()]
        if not {"x", "y", "z"} <= set(columns) or len({"r", "g", "b"} & set(columns)) not in (0, 3):
            raise ValueError("a PLY cloud needs x, y and z, and all or none of r, g and b")
        encoding = self.options.get("encoding", "ascii")
        if encoding not in ("ascii", "binary_little_endian", "binary_big_endian"):
            raise ValueError(f"unknown PLY format: {encoding}")
        return PlyWriter(self.options["path"], columns, encoding, overwrite)
