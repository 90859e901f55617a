"""LAS files as a Spark data source: ``format("las")`` and ``format("las_header")``.

Point records have a fixed length, so a file is read in ranges of records, one
a partition, each decoded as columns. A range that is shorter than its header
declares fails the job. ``idx`` numbers the points of all files read together,
in order of path; ``record`` is a point's place in its own file. Writing is
published by the commit of the whole job; a failed job leaves what was there.
Compressed files are not read. Paths are those of ``pyarrow.fs``: URIs, or
without a scheme local folders and shared mounts; the functions below send
paths without a scheme to the cluster's default file system.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.codes import UPGRADES
from ..session import checkpointed, grown, qualified
from .publishing import Publisher, Written, discard_folder, located, names_in

#: Fields of the point formats, fixed values: (name, numpy type).
_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("_returns", "u1"), ("_class", "u1"), ("scan_angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("_returns", "u1"), ("_flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
_WAVE = [("wavepacket_index", "u1"), ("wavepacket_offset", "<u8"), ("wavepacket_size", "<u4"), ("return_point_wave_location", "<f4"), ("x_t", "<f4"), ("y_t", "<f4"), ("z_t", "<f4")]
_GPS, _NIR = [("gps_time", "<f8")], [("nir", "<u2")]
FORMATS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 4: _OLD + _GPS + _WAVE, 5: _OLD + _GPS + _RGB + _WAVE,
           6: _NEW, 7: _NEW + _RGB, 8: _NEW + _RGB + _NIR, 9: _NEW + _WAVE, 10: _NEW + _RGB + _NIR + _WAVE}
#: Packed bits, fixed values: name -> (column, shift, width).
_OLD_BITS = {"return_number": ("_returns", 0, 3), "number_of_returns": ("_returns", 3, 3), "scan_direction_flag": ("_returns", 6, 1), "edge_of_flight_line": ("_returns", 7, 1),
             "classification": ("_class", 0, 5), "synthetic": ("_class", 5, 1), "key_point": ("_class", 6, 1), "withheld": ("_class", 7, 1)}
_NEW_BITS = {"return_number": ("_returns", 0, 4), "number_of_returns": ("_returns", 4, 4), "synthetic": ("_flags", 0, 1), "key_point": ("_flags", 1, 1), "withheld": ("_flags", 2, 1),
             "overlap": ("_flags", 3, 1), "scanner_channel": ("_flags", 4, 2), "scan_direction_flag": ("_flags", 6, 1), "edge_of_flight_line": ("_flags", 7, 1)}
#: Types of extra bytes, fixed values, in the order of their codes from 1.
_EXTRA = ("u1", "i1", "<u2", "<i2", "<u4", "<i4", "<u8", "<i8", "<f4", "<f8")
#: numpy kind and size -> Spark type; unsigned 64-bit needs a decimal to stay exact.
_SPARK = {"u1": "short", "i1": "byte", "u2": "int", "i2": "short", "u4": "long", "i4": "int", "u8": "decimal(20,0)", "i8": "long", "f4": "float", "f8": "double"}
RANGE = 1_000_000
#: Most points of a written file; a source with more is written in several.
PART = 50_000_000
#: Files whose headers the driver reads at a time when it plans a read by itself.
HEADERS_AT_ONCE = 32
#: Files whose headers a task reads.
HEADERS_A_TASK = 64
#: Stored whole numbers, named apart from the coordinates made of them.
RAW = {"X": "raw_x", "Y": "raw_y", "Z": "raw_z"}
_STORED = {v: k for k, v in RAW.items()}
#: Columns that every read has.
OWN = ("idx", "path", "record", "x", "y", "z")


def bits_of(point_format: int) -> dict:
    return _OLD_BITS if point_format < 6 else _NEW_BITS


@dataclass(frozen=True)
class Header:
    path: str
    size: int
    version: tuple[int, int]
    encoding: int
    offset: int
    point_format: int
    record_length: int
    count: int
    scales: tuple[float, ...]
    offsets: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    vlrs: tuple[tuple[str, int, bytes], ...]
    #: As they stand in the file: the header, each record behind it, each extended record at the end.
    head: bytes = b""
    records: tuple[bytes, ...] = ()
    extended: tuple[bytes, ...] = ()

    @property
    def extra(self) -> list[tuple[str, str, int, float | None, float]]:
        """(name, numpy type, elements, scale or None, offset) of the extra bytes."""
        out = []
        for user, record, data in self.vlrs:
            if (user, record) != ("LASF_Spec", 4):
                continue
            for k in range(0, len(data) - 191, 192):
                kind, options, name = data[k + 2], data[k + 3], data[k + 4 : k + 36].split(b"\0")[0].decode()
                scale, base = struct.unpack_from("<d", data, k + 112)[0], struct.unpack_from("<d", data, k + 136)[0]
                if 1 <= kind <= 30:
                    out.append((name, _EXTRA[(kind - 1) % 10], (kind - 1) // 10 + 1, scale if options & 8 else 1.0 if options & 16 else None, base if options & 16 else 0.0))
                else:
                    out.append((name, f"V{options if kind == 0 else 1}", 1, None, 0.0))
        return out

    @property
    def columns(self) -> list[tuple[str, str | None]]:
        """Columns of each extra dimension, and of its stored numbers where they are scaled.

        That is the dimension's name; where another column has it (case
        ignored), ``extra_`` goes before it until none has.
        """
        taken = {n.lower() for n, _ in _fixed_columns(self.point_format)}

        def free(name: str) -> str:
            while name.lower() in taken:
                name = f"extra_{name}"
            taken.add(name.lower())
            return name

        return [(free(name), free(f"{name}_raw") if scale is not None and k == 1 else None) for name, _, k, scale, _ in self.extra]

    @property
    def dtype(self) -> np.dtype:
        fields = _record_fields(self.point_format, self.extra)
        rest = self.record_length - np.dtype(fields).itemsize
        if rest < 0:
            raise ValueError(f"{self.path}: records are shorter than their fields")
        return np.dtype(fields + ([("_rest", f"V{rest}")] if rest else []))


def _record_fields(point_format: int, extra: list[tuple]) -> list[tuple]:
    """numpy fields of a record; extra dimensions go by number, since their names may be anything."""
    return list(FORMATS[point_format]) + [(f"+{i}", t) if k == 1 else (f"+{i}", t, (k,)) for i, (_, t, k, *_) in enumerate(extra)]


#: User ids of records that do not describe copied points, fixed values.
LAYOUT_RECORDS = ("copc", "laszip encoded")


def _user(raw: bytes) -> str:
    return raw[2:18].split(b"\0")[0].decode(errors="replace")


def read_header(path: str, ends: bool = False) -> Header:
    """The header of a file; with ``ends``, also its extended records."""
    where, name = located(path)
    with where.open_input_file(name) as file:
        size = file.size()
        head = file.read(375)
        if head[:4] != b"LASF" or len(head) < 227:
            raise ValueError(f"{path}: no LAS file")
        at = struct.unpack_from
        fmt = head[104]
        if fmt & 0x80:
            raise ValueError(f"{path}: compressed points are not read")
        version, start, offset, n_vlr = (head[24], head[25]), at("<H", head, 94)[0], at("<I", head, 96)[0], at("<I", head, 100)[0]
        new = version >= (1, 4) and len(head) >= 375
        count = at("<Q", head, 247)[0] if new else at("<I", head, 107)[0]
        bounds = at("<6d", head, 179)
        file.seek(start)
        raw, records, k = file.read(max(offset - start, 0)), [], 0
        for _ in range(n_vlr):
            length = 54 + at("<H", raw, k + 20)[0]
            records.append(raw[k : k + length])
            k += length
        extended = []
        if ends and new:
            place, n_extended = at("<Q", head, 235)[0], at("<I", head, 243)[0]
            for _ in range(n_extended):
                file.seek(place)
                opening = file.read(60)
                extended.append(opening + file.read(at("<Q", opening, 20)[0]))
                place += len(extended[-1])
    vlrs = tuple((_user(r), at("<H", r, 18)[0], r[54:]) for r in records)
    return Header(path, size, version, at("<H", head, 6)[0], offset, fmt & 0x3F, at("<H", head, 105)[0], count, at("<3d", head, 131), at("<3d", head, 155), bounds[1::2], bounds[0::2], vlrs, head[:start], tuple(records), tuple(extended))


def _fixed_columns(point_format: int) -> list[tuple[str, str]]:
    """(name, Spark type) of the columns that all files of a format have."""
    out = list(zip(OWN, ("long", "string", "long", "double", "double", "double"), strict=True))
    out += [(RAW.get(n, n), _SPARK[np.dtype(t).str[1:]]) for n, t in FORMATS[point_format] if n[0] != "_"]
    return out + [(n, "short") for n in bits_of(point_format)]


def _columns(header: Header) -> list[tuple[str, str]]:
    """(name, Spark type) of a file's rows."""
    out = _fixed_columns(header.point_format)
    for (_, t, k, scale, _), (column, stored) in zip(header.extra, header.columns, strict=True):
        if t[0] != "V":
            kind = "double" if scale is not None else _SPARK[t.lstrip("<")]
            out.append((column, kind if k == 1 else f"array<{kind}>"))
            if stored:
                out.append((stored, _SPARK[t.lstrip("<")]))
    return out


def _arrow(values: np.ndarray, kind: str) -> pa.Array:
    if kind == "decimal(20,0)":
        return pa.array(values.astype("<u8"), pa.uint64()).cast(pa.decimal128(20, 0))
    if values.ndim == 2:
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), _arrow(values.ravel(), kind[6:-1]))
    return pa.array(values.astype({"short": "i2", "byte": "i1", "int": "i4", "long": "i8", "float": "f4", "double": "f8"}[kind]))


#: x0, y0, x1, y1; its edges belong to it.
Box = tuple[float, float, float, float]


def decode(header: Header, records: np.ndarray, numbers: np.ndarray, start: int = 0, kinds: list[tuple[str, str]] | None = None) -> pa.RecordBatch:
    """Columns ``kinds`` (all by default) of ``records`` with these numbers in their file, which starts at idx ``start``."""
    kinds = _columns(header) if kinds is None else kinds
    bits = bits_of(header.point_format)
    extra = {column: (i, e) for i, (e, (column, _)) in enumerate(zip(header.extra, header.columns, strict=True))}
    stored = {column: i for i, (_, column) in enumerate(header.columns) if column}
    out = []
    for name, kind in kinds:
        if name == "idx":
            out.append(pa.array(start + numbers))
        elif name == "record":
            out.append(pa.array(numbers))
        elif name == "path":
            out.append(pa.array([header.path] * len(records), pa.string()))
        elif name in ("x", "y", "z"):
            out.append(pa.array(_real(header, records, name)))
        elif name in bits and name not in records.dtype.names:
            source, shift, width = bits[name]
            out.append(_arrow(records[source] >> shift & (1 << width) - 1, kind))
        elif name in extra:
            i, (_, _, _, scale, base) = extra[name]
            values = records[f"+{i}"]
            out.append(_arrow(values if scale is None else values * scale + base, kind))
        elif name in stored:
            out.append(_arrow(records[f"+{stored[name]}"], kind))
        else:
            out.append(_arrow(records[_STORED.get(name, name)], kind))
    return pa.RecordBatch.from_arrays(out, [n for n, _ in kinds])


def _real(header: Header, records: np.ndarray, axis: str) -> np.ndarray:
    k = "xyz".index(axis)
    return records[axis.upper()] * header.scales[k] + header.offsets[k]


def _paths(path: str) -> list[str]:
    where, name = located(path)
    info = where.get_file_info(name)
    if info.type == fs.FileType.File:
        return [path]
    prefix = path.rstrip("/")
    found = where.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted(f"{prefix}/{f.base_name}" for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".las"))


def decoded(path: str, first: int, count: int, start: int, kinds: list[tuple[str, str]], wanted: list[tuple[str, str]] | None = None, box: Box | None = None) -> Iterator[pa.RecordBatch]:
    """A range of a file's records, 100,000 at a time: the ``wanted`` of its columns ``kinds``, of points in ``box``."""
    header = read_header(path)
    if _columns(header) != kinds:
        raise ValueError(f"{path}: dimensions differ from the first file's; read it by itself")
    where, name = located(path)
    step = 100_000
    with where.open_input_file(name) as file:
        for k in range(first, first + count, step):
            n = min(step, first + count - k)
            file.seek(header.offset + k * header.record_length)
            raw = file.read(n * header.record_length)
            if len(raw) != n * header.record_length:
                raise ValueError(f"{path}: {header.count} points declared, the file ends before point {k + n}")
            records, numbers = np.frombuffer(raw, header.dtype), np.arange(k, k + n, dtype=np.int64)
            if box:
                x, y = _real(header, records, "x"), _real(header, records, "y")
                inside = (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
                records, numbers = records[inside], numbers[inside]
            yield decode(header, records, numbers, start, wanted)


class RecordRange(InputPartition):
    def __init__(self, path: str, first: int, count: int, start: int = 0):
        self.path, self.first, self.count, self.start = path, first, count, start


class LasReader(DataSourceReader):
    """Plans by reading headers on the driver, some at a time; ``read_points`` does so in a job."""

    def __init__(self, paths: list[str], size: int, kinds: list[tuple[str, str]]):
        self.paths, self.size, self.kinds = paths, size, kinds

    def partitions(self):
        ranges, start = [], 0
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
            counts = pool.map(lambda p: read_header(p).count, self.paths)
        for path, count in zip(self.paths, counts, strict=True):
            ranges += [RecordRange(path, k, min(self.size, count - k), start) for k in range(0, count, self.size)]
            start += count
        return ranges or [RecordRange("", 0, 0)]

    def read(self, part: RecordRange):
        if part.count:
            yield from decoded(part.path, part.first, part.count, part.start, self.kinds)


class LasArrivals(DataSourceStreamReader):
    """LAS files of a folder as they arrive, each exactly once.

    Which files a batch has is written to the folder ``log`` before the batch
    exists, one small file a batch, so a query that starts again from its
    checkpoint reads the same files for the same batch and none twice. An
    offset is the number of batches so far. Files must appear under their
    final name when they are complete (moved there, as publications do).
    ``idx`` counts inside a file; with ``path`` it tells points apart.
    """

    def __init__(self, path: str, log: str, size: int, kinds: list[tuple[str, str]]):
        self.path, self.log, self.size, self.kinds = path, log, size, kinds
        self.seen, self.read_until = set(), 0

    def _file(self, batch: int) -> tuple[fs.FileSystem, str]:
        where, folder = located(self.log)
        return where, f"{folder}/{batch:012d}.json"

    def _batch(self, number: int) -> list[str]:
        where, name = self._file(number)
        with where.open_input_stream(name) as file:
            return json.loads(file.read())

    def initialOffset(self):
        return {"batch": 0}

    def latestOffset(self):
        where, folder = located(self.log)
        where.create_dir(folder, recursive=True)
        known = sum(n.endswith(".json") for n in names_in(where, folder))
        for number in range(self.read_until + 1, known + 1):
            self.seen |= set(self._batch(number))
        self.read_until = known
        new = [p for p in _paths(self.path) if p not in self.seen]
        if new:
            where, name = self._file(known + 1)
            with where.open_output_stream(f"{name}.part") as out:
                out.write(json.dumps(new).encode())
            where.move(f"{name}.part", name)
            self.seen, self.read_until = self.seen | set(new), known + 1
        return {"batch": self.read_until}

    def partitions(self, start, end):
        paths = [p for number in range(start["batch"] + 1, end["batch"] + 1) for p in self._batch(number)]
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
            counts = pool.map(lambda p: read_header(p).count, paths)
        return [RecordRange(p, k, min(self.size, n - k)) for p, n in zip(paths, counts, strict=True) for k in range(0, n, self.size)] or [RecordRange("", 0, 0)]

    def read(self, part: RecordRange):
        if part.count:
            yield from decoded(part.path, part.first, part.count, part.start, self.kinds)


#: GeoTIFF keys that tell units, fixed values; columns geo_<key>.
GEO_KEYS = (1024, 3072, 3076, 4096, 4099)


def geo_keys(vlrs) -> list[int | None]:
    """Values of ``GEO_KEYS`` in a GeoKeyDirectory record, null where absent."""
    found = {}
    for user, record, data in vlrs:
        if (user, record) == ("LASF_Projection", 34735) and len(data) >= 8:
            numbers = np.frombuffer(data[: len(data) // 8 * 8], "<u2").reshape(-1, 4)[1:]
            found |= {int(key): int(value) for key, place, _, value in numbers if place == 0}
    return [found.get(k) for k in GEO_KEYS]


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class HeaderReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [Paths(self.paths[k : k + HEADERS_A_TASK]) for k in range(0, len(self.paths), HEADERS_A_TASK)] or [Paths([])]

    def read(self, part: Paths):
        with ThreadPoolExecutor(8) as pool:
            yield from pool.map(header_row, part.paths)


def header_row(path: str) -> tuple:
    try:
        h = read_header(path)
        wkt = next((d.split(b"\0")[0].decode(errors="replace") for u, r, d in h.vlrs if (u, r) == ("LASF_Projection", 2112)), None)
        waves = bool(h.encoding & 6) or h.point_format in (4, 5, 9, 10)
        dims = [(name, np.dtype(t).kind, k, scale is not None) for name, t, k, scale, _ in h.extra]
        return (path, h.count, h.size, h.point_format, *h.low, *h.high, waves, wkt, [(u, r, d) for u, r, d in h.vlrs], dims, *geo_keys(h.vlrs), None)
    except Exception as error:  # an unreadable file is listed with its reason
        where, name = located(path)
        return (path, 0, where.get_file_info(name).size or 0, None, *[None] * 6, None, None, [], [], *[None] * len(GEO_KEYS), str(error))


class LasHeaders(DataSource):
    """One row a file: path, declared_count, size, point_format, bounds, waveforms, wkt, vlrs, extra dimensions, geo keys, warning."""

    @classmethod
    def name(cls):
        return "las_header"

    def schema(self):
        keys = "".join(f"geo_{k} int, " for k in GEO_KEYS)
        return ("path string, declared_count long, size long, point_format int, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, "
                "waveforms boolean, wkt string, vlrs array<struct<user_id:string,record_id:int,data:binary>>, dims array<struct<dim:string,kind:string,n:int,scaled:boolean>>, " + keys + "warning string")  # fmt: skip

    def reader(self, schema):
        return HeaderReader(_paths(self.options["path"]))


#: Records that a task of ``write_copies`` and ``write_classified`` sorts and writes at once; a file's sections are then put together.
SECTION = 250_000
_SECTION = "place string, count long, low array<long>, high array<long>, returns array<long>"


class Body:
    """Records on their way to a file, with what its header needs to know of them."""

    def __init__(self, where: fs.FileSystem, path: str):
        self.where, self.path = where, path
        self.out = where.open_output_stream(f"{path}.body")
        self.count, self.returns, self.sections = 0, np.zeros(16, np.int64), []
        self.low, self.high = np.full(3, np.iinfo("i4").max, np.int64), np.full(3, np.iinfo("i4").min, np.int64)

    def section(self) -> dict:
        """What another body needs to take these records over from ``place``, where they stay."""
        self.out.close()
        return {"place": f"{self.path}.body", "count": self.count, **{n: getattr(self, n).tolist() for n in ("low", "high", "returns")}}

    def take(self, section: dict) -> None:
        """Records of a section, read when the file is closed."""
        self.sections.append(section["place"])
        self.count += section["count"]
        self.low, self.high = np.minimum(self.low, section["low"]), np.maximum(self.high, section["high"])
        self.returns += np.array(section["returns"])

    def add(self, records: np.ndarray, return_bits: int) -> None:
        if len(records):
            whole = np.stack([records[c] for c in "XYZ"]).astype(np.int64)
            self.low, self.high = np.minimum(self.low, whole.min(1)), np.maximum(self.high, whole.max(1))
            self.returns += np.bincount(records["_returns"] & (1 << return_bits) - 1, minlength=16)
            self.out.write(records.tobytes())
            self.count += len(records)

    def close(self, head: bytes, tail: bytes = b"") -> None:
        self.out.close()
        if self.count:
            with self.where.open_output_stream(self.path) as out:
                out.write(head)
                for place in self.sections or [f"{self.path}.body"]:
                    with self.where.open_input_stream(place) as points:
                        while chunk := points.read(1 << 22):
                            out.write(chunk)
                out.write(tail)
        self.where.delete_file(f"{self.path}.body")

    def patch(self, head: bytearray, point_format: int, record_length: int, n_vlr: int, offset: int, scales, offsets) -> None:
        """What depends on the points, in place."""
        struct.pack_into("<IIBH", head, 96, offset, n_vlr, point_format, record_length)
        old = point_format < 6
        struct.pack_into("<6I", head, 107, *([self.count, *self.returns[1:6]] if old else [0] * 6))
        low, high = (v * np.array(scales) + np.array(offsets) for v in (self.low, self.high))
        struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
        if len(head) >= 375:
            struct.pack_into("<16Q", head, 247, self.count, *self.returns[1:16])


def _packed(batch: pa.RecordBatch, bits: dict, records: np.ndarray) -> None:
    """Fills the packed bits that the batch has columns for; a value that does not fit fails the job."""
    for n, (source, shift, width) in bits.items():
        if n in batch.schema.names:
            values = batch.column(batch.schema.names.index(n)).to_numpy(zero_copy_only=False).astype("i8")
            if len(values) and not (0 <= values.min() and values.max() < 1 << width):
                raise ValueError(f"{n} does not fit in {width} bits")
            records[source] |= (values << shift).astype("u1")


class LasWriter(Publisher):
    """Points in format 6, or 7 with colours; columns that the format lacks become extra bytes.

    Coordinates are stored as whole numbers of ``scale`` from ``offsets``; one
    that does not fit in 32 bits, or is not finite, fails the job.
    """

    def __init__(self, path: str, schema: StructType, scale: float, overwrite: bool, offsets: tuple[float, float, float] = (0.0, 0.0, 0.0)):
        super().__init__(path, overwrite)
        self.scale, self.offsets = scale, offsets
        names = [f.name for f in schema.fields]
        self.format = 7 if {"red", "green", "blue"} <= set(names) else 6
        known = {n for n, _ in FORMATS[self.format]} | set(_NEW_BITS) | {"x", "y", "z", "idx", "path", "record", *_STORED}
        types = {"byte": "i1", "short": "<i2", "integer": "<i4", "long": "<i8", "float": "<f4", "double": "<f8", "decimal(20,0)": "<u8"}
        self.extra = [(f.name, types[f.dataType.typeName() if f.dataType.typeName() != "decimal" else f.dataType.simpleString()]) for f in schema.fields
                      if f.name not in known and (f.dataType.typeName() in types or f.dataType.simpleString() in types)]

    def write(self, batches):
        where, folder = self._folder()
        name = f"part-{uuid.uuid4().hex}.las"
        body = Body(where, f"{folder}/{name}")
        for batch in batches:
            body.add(self._encode(batch), 4)
        body.close(self._header(body))
        return Written(((name, name, body.count),) if body.count else ())

    def section(self, folder: str, batches: Iterable[pa.RecordBatch]) -> dict | None:
        """The section of a file, written to ``folder``; none without points."""
        where, folder = located(folder)
        where.create_dir(folder, recursive=True)
        body = Body(where, f"{folder}/{uuid.uuid4().hex}")
        for batch in batches:
            body.add(self._encode(batch), 4)
        found = body.section()
        return found if body.count else None

    def _dtype(self) -> np.dtype:
        return np.dtype(FORMATS[self.format] + self.extra)

    def _encode(self, batch: pa.RecordBatch) -> np.ndarray:
        records = np.zeros(batch.num_rows, self._dtype())
        names = batch.schema.names
        get = lambda n: batch.column(names.index(n)).to_numpy(zero_copy_only=False)
        for c, offset in zip("xyz", self.offsets, strict=True):
            steps = np.rint((get(c).astype("f8") - offset) / self.scale)
            if not (np.abs(steps) < 2**31).all():
                raise ValueError(f"{c} does not fit in 32 bits at scale {self.scale} from offset {offset}")
            records[c.upper()] = steps.astype("i4")
        for n, t in [*FORMATS[self.format], *self.extra]:
            if n in names and n not in "XYZ":
                records[n] = get(n).astype(t)
        _packed(batch, _NEW_BITS, records)
        return records

    def _header(self, body: Body) -> bytes:
        vlr = b""
        if self.extra:
            data = b"".join(struct.pack("<2xBB32s4x24x24x24x24x24x32x", _EXTRA.index(t) + 1, 0, n.encode()[:32]) for n, t in self.extra)
            vlr = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(data), b"Extra bytes") + data
        head = bytearray(375)
        struct.pack_into("<4sHH", head, 0, b"LASF", 0, 0)
        head[24], head[25] = 1, 4
        struct.pack_into("<H", head, 94, 375)
        struct.pack_into("<3d3d", head, 131, *[self.scale] * 3, *self.offsets)
        body.patch(head, self.format, self._dtype().itemsize, int(bool(vlr)), 375 + len(vlr), [self.scale] * 3, self.offsets)
        return bytes(head) + vlr


class LasJoiner(LasWriter):
    """Files of sections (file, sections in their order), a row a file."""

    def write(self, batches):
        (where, folder), done = self._folder(), []
        for row in (r for batch in batches for r in batch.to_pylist()):
            name = f"part-{uuid.uuid4().hex}.las"
            body = Body(where, f"{folder}/{name}")
            for section in row["sections"]:
                body.take(section)
            body.close(self._header(body))
            done.append((name, name, body.count))
        return Written(tuple(done))


class LasCopier(Publisher):
    """Each source file again, with other labels and everything else it had.

    Rows carry path, record, the stored whole numbers and every dimension of
    the source. Scales, offsets, records behind the header and at the end are
    the source's; with ``upgrade``, formats below 6 become their successors.
    ``field`` is the dimension of the label; a new one is added as an extra
    byte. A dimension that could not be kept fails the job.
    """

    def __init__(self, path: str, schema: StructType | None, upgrade: bool, field: str, suffix: str, part: int, provenance: str, stage: str = ""):
        super().__init__(path, False, stage)
        self.upgrade, self.field, self.suffix, self.part, self.provenance = upgrade, field, suffix, part, provenance
        missing = {"path", "record", *_STORED, field} - {f.name for f in schema.fields} if schema else None
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")

    def write(self, batches):
        where, folder = self._folder()
        attempt = uuid.uuid4().hex
        key, body, done, source, name = None, None, [], None, ""

        def finish():
            body.close(*self._ends(source, body))
            done.append((name, f"{attempt}-{name}", body.count))

        for now, rows in self._runs(batches, self.part):
            if now != key:
                if body:
                    finish()
                key, source = now, read_header(now[0], ends=True)
                name = self._name(source, now[1])
                body = Body(where, f"{folder}/{attempt}-{name}")
            body.add(self._encode(source, rows), 3 if self._format(source) < 6 else 4)
        if body:
            finish()
        return Written(tuple(done))

    def _runs(self, batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[tuple[str, int, int], pa.RecordBatch]]:
        """((path, part, run of ``size`` records), rows that follow each other and have these)."""
        for batch in batches:
            names = batch.schema.names
            paths, records = batch.column(names.index("path")), batch.column(names.index("record")).to_numpy()
            at = paths.dictionary_encode().indices.to_numpy() if len(paths) else np.zeros(0, int)
            parts, runs = records // self.part, records // size
            starts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (parts[1:] != parts[:-1]) | (runs[1:] != runs[:-1])) + 1), len(at)]
            for a, b in zip(starts, starts[1:], strict=False):
                if a < b:
                    yield (paths[a].as_py(), int(parts[a]), int(runs[a])), batch.slice(int(a), int(b - a))

    def _name(self, source: Header, part: int) -> str:
        stem = source.path.rsplit("/", 1)[1].rsplit(".", 1)[0]
        return f"{stem}{self.suffix}{f'-{part:05d}' if source.count > self.part else ''}.las"

    def sections(self, folder: str, size: int, batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        """Sections of at most ``size`` records, written to ``folder``, with path, part and run; ``batches`` are sorted by path and record."""
        where, folder = located(folder)
        where.create_dir(folder, recursive=True)
        key, body, source = None, None, None
        for now, rows in self._runs(batches, size):
            if now != key:
                if body:
                    yield dict(zip(("path", "part", "run"), key, strict=True)) | body.section()
                source = source if key and now[0] == key[0] else read_header(now[0])
                key, body = now, Body(where, f"{folder}/{uuid.uuid4().hex}")
            body.add(self._encode(source, rows), 3 if self._format(source) < 6 else 4)
        if body:
            yield dict(zip(("path", "part", "run"), key, strict=True)) | body.section()

    def _format(self, source: Header) -> int:
        return UPGRADES.get(source.point_format, source.point_format) if self.upgrade else source.point_format

    def _extra(self, source: Header) -> list[tuple]:
        """(name, type, elements, scale, offset, column) of the result's extra dimensions: the source's, and a label of its own name."""
        if any(kind[0] == "V" for _, kind, *_ in source.extra) or "_rest" in (source.dtype.names or ()):
            raise ValueError(f"{source.path}: bytes without a described type would be lost")
        have = [(*e, self.field if e[0] == self.field else stored or column) for e, (column, stored) in zip(source.extra, source.columns, strict=True)]
        if self.upgrade and source.point_format < 6 and "scan_angle_rank" not in [e[0] for e in have]:
            have.append(("scan_angle_rank", "i1", 1, None, 0.0, "scan_angle_rank"))
        if self.field != "classification" and self.field not in [e[0] for e in have]:
            have.append((self.field, LABEL_TYPE, 1, None, 0.0, self.field))
        return have

    def _encode(self, source: Header, batch: pa.RecordBatch) -> np.ndarray:
        fmt, extra, names = self._format(source), self._extra(source), batch.schema.names
        records = np.zeros(batch.num_rows, np.dtype(_record_fields(fmt, extra)))
        get = lambda n: batch.column(names.index(n)).to_numpy(zero_copy_only=False)
        for stored, column in RAW.items():
            records[stored] = get(column)
        for n, t in FORMATS[fmt]:
            if n[0] == "_" or n in RAW:
                continue
            if n == "scan_angle" and n not in names:
                records[n] = np.rint(get("scan_angle_rank") / 0.006)
            elif n == "classification":
                records[n] = _fits(get(n), n, t)
            else:
                records[n] = get(n)
        _packed(batch, bits_of(fmt), records)
        for i, (n, t, k, scale, base, column) in enumerate(extra):
            if k > 1:
                values = np.array([list(v) for v in batch.column(names.index(column)).to_pylist()])
                records[f"+{i}"] = np.rint((values - base) / scale) if scale is not None else values
            else:
                records[f"+{i}"] = _fits(get(column), n, t)
        return records

    def _replaced(self, raw: bytes) -> bool:
        """Whether a record tells what labelled this field before; what other fields have stays."""
        if not self.provenance or (_user(raw), struct.unpack_from("<H", raw, 18)[0]) != (PROVENANCE_USER, 1):
            return False
        try:
            return json.loads(raw[54:]).get("field", self.field) == self.field
        except (ValueError, AttributeError):
            return True  # cannot be read by anyone

    def _ends(self, source: Header, body: Body) -> tuple[bytes, bytes]:
        """(all before the points, all behind them)."""
        fmt, extra = self._format(source), self._extra(source)
        kept = [r for r in source.records if _user(r).lower() not in LAYOUT_RECORDS and (_user(r), struct.unpack_from("<H", r, 18)[0]) != ("LASF_Spec", 4) and not self._replaced(r)]
        described = b"".join(d for u, r, d in source.vlrs if (u, r) == ("LASF_Spec", 4))
        described += b"".join(struct.pack("<2xBB32s4x24x24x24x24x24x32x", _EXTRA.index(t) + 1, 0, n.encode()[:32]) for n, t, *_ in extra[len(source.extra) :])  # the added ones
        if described:
            kept.append(struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(described), b"Extra bytes") + described)
        if self.provenance:
            text = self.provenance.encode()
            kept.append(struct.pack("<H16sHH32s", 0, PROVENANCE_USER.encode(), 1, len(text), b"What labelled the points") + text)
        head = bytearray(source.head if fmt < 6 or len(source.head) >= 375 else source.head[:227] + bytes(148))
        if fmt >= 6:
            head[24:26] = bytes([1, 4])
            if any((u, r) == ("LASF_Projection", 2112) for u, r, _ in source.vlrs):
                head[6] |= 16
        struct.pack_into("<H", head, 94, len(head))
        length = np.dtype(_record_fields(fmt, extra)).itemsize
        offset = len(head) + sum(map(len, kept))
        body.patch(head, fmt, length, len(kept), offset, source.scales, source.offsets)
        extended = [e for e in source.extended if _user(e).lower() not in LAYOUT_RECORDS]
        if len(head) >= 375:
            struct.pack_into("<QI", head, 235, offset + length * body.count if extended else 0, len(extended))
        return bytes(head) + b"".join(kept), b"".join(extended)


class CopyJoiner(LasCopier):
    """Copies of source files by their sections (path, part, sections in their order), a row a file."""

    def __init__(self, path: str, *options):
        super().__init__(path, None, *options)

    def write(self, batches):
        (where, folder), attempt, done = self._folder(), uuid.uuid4().hex, []
        for row in (r for batch in batches for r in batch.to_pylist()):
            source = read_header(row["path"], ends=True)
            name = self._name(source, row["part"])
            body = Body(where, f"{folder}/{attempt}-{name}")
            for section in row["sections"]:
                body.take(section)
            body.close(*self._ends(source, body))
            done.append((name, f"{attempt}-{name}", body.count))
        return Written(tuple(done))


#: User id of the records that say what labelled a file, one a field.
PROVENANCE_USER = "pointloom"
#: Type of a label field that a file lacked.
LABEL_TYPE = "<i4"


def _fits(values: np.ndarray, name: str, kind: str) -> np.ndarray:
    """Values for a dimension of that type; one that it cannot hold fails the job."""
    if np.dtype(kind).kind in "iu" and len(values):
        bounds = np.iinfo(kind)
        if not (bounds.min <= values.min() and values.max() <= bounds.max):
            raise ValueError(f"{name} does not fit")
    return values


class Las(DataSource):
    """Point records of a .las file or of a folder's; option ``range``: records a partition; ``like``: a file whose dimensions all have. As a stream: files as they arrive, option ``log``: a folder for what was seen. Writing: options ``scale``, ``offset_x``, ``offset_y``, ``offset_z``."""

    @classmethod
    def name(cls):
        return "las"

    def _first(self) -> Header:
        paths = [self.options["like"]] if "like" in self.options else _paths(self.options["path"])
        if not paths:
            raise FileNotFoundError(f"no .las file in {self.options['path']}")
        return read_header(paths[0])

    def schema(self):
        return ", ".join(f"`{n}` {t}" for n, t in _columns(self._first()))

    def reader(self, schema):
        return LasReader(_paths(self.options["path"]), int(self.options.get("range", RANGE)), _columns(self._first()))

    def streamReader(self, schema):
        return LasArrivals(self.options["path"], self.options["log"], int(self.options.get("range", RANGE)), _columns(self._first()))

    def writer(self, schema, overwrite):
        if "field" in self.options:
            return CopyJoiner(self.options["path"], self.options["upgrade"] == "true", self.options["field"], self.options["suffix"], int(self.options["part"]), self.options["provenance"], self.options.get("stage", ""))
        if "sections" in self.options:  # the schema of the points
            return LasJoiner(self.options["path"], StructType.fromJson(json.loads(self.options["sections"])), float(self.options["scale"]), overwrite, tuple(float(self.options[f"offset_{c}"]) for c in "xyz"))
        return LasWriter(self.options["path"], schema, float(self.options.get("scale", 0.001)), overwrite, tuple(float(self.options.get(f"offset_{c}", 0)) for c in "xyz"))


def register(spark: SparkSession) -> SparkSession:
    """Makes the formats known to the session."""
    spark.dataSource.register(Las)
    spark.dataSource.register(LasHeaders)
    return spark


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file of ``path``, read by the cluster; points stay unread."""
    return register(spark).read.format("las_header").load(qualified(spark, path))


def read_points(spark: SparkSession, path: str, size: int = RANGE, box: Box | None = None, columns: list[str] | None = None) -> DataFrame:
    """The points of a file or folder, planned by a job over its headers.

    Columns as of ``format("las")``, or ``columns`` of them; only these are
    decoded. With a ``box``, files whose bounds lie outside stay unopened, and
    of the others only points inside come back, with the idx that they have
    in the whole folder. Only one header is read by the driver, for the
    columns; ranges of ``size`` records are dealt to the tasks. Files that
    cannot be read, or with other dimensions, fail.
    """
    heads = checkpointed(scan_headers(spark, path).select("path", "declared_count", "warning", "min_x", "min_y", "max_x", "max_y"))
    for bad in heads.where("warning is not null").orderBy("path").limit(1).collect():
        raise ValueError(bad.warning)
    first = heads.agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no .las file in {path}")
    kinds = _columns(read_header(first))
    unknown = set(columns or []) - {n for n, _ in kinds}
    if unknown:
        raise ValueError(f"{first} has no columns {sorted(unknown)}")
    wanted = [(n, t) for n, t in kinds if columns is None or n in columns]
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = heads.select("*", F.coalesce(F.sum("declared_count").over(before), F.lit(0)).alias("start")).where("declared_count > 0")
    if box:
        starts = starts.where((F.col("max_x") >= box[0]) & (F.col("min_x") <= box[2]) & (F.col("max_y") >= box[1]) & (F.col("min_y") <= box[3]))
    ranges = starts.select("path", "declared_count", "start", F.explode(F.expr(f"sequence(0L, declared_count - 1, {size}L)")).alias("first"))
    ranges = checkpointed(ranges.select("path", "first", F.least(F.lit(size), F.col("declared_count") - F.col("first")).alias("count"), "start"))

    def read(batches):
        for batch in batches:
            for part in batch.to_pylist():
                yield from decoded(part["path"], part["first"], part["count"], part["start"], kinds, wanted, box)

    dealt = ranges.repartition(max(1, ranges.count()), "path", "first")
    # its size is estimated from the few rows of ``ranges``
    return grown(dealt.mapInArrow(read, ", ".join(f"`{n}` {t}" for n, t in wanted)))


def write_copies(points: DataFrame, folder: str, field: str = "classification", upgrade: bool = False, suffix: str = "", provenance: str = "", part: int = PART, stage: str = "") -> None:
    """The source files of ``points`` (columns of ``read_points``) again in ``folder``, labels from column ``field``.

    Files keep names, order, header, records and all dimensions; sources of
    more than ``part`` points come in several files. Tasks sort and write
    sections of ``SECTION`` records, whatever the file's size; one task a file
    then puts them together as bytes. A file of the same name is replaced when the whole job is done; with
    a name for a ``stage``, when ``publish_staged`` is called.
    """
    register(points.sparkSession)
    at = qualified(points.sparkSession, folder)
    copier, place = LasCopier(at, points.schema, upgrade, field, suffix, part, provenance), f"{at.rstrip('/')}/_sections-{uuid.uuid4().hex}"
    size = SECTION  # of this process

    def write(batches):
        rows = list(copier.sections(place, size, batches))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _row(_COPIED))

    ordered = points.withColumns({"_part": F.expr(f"record div {part}"), "_run": F.expr(f"record div {size}")}).repartition("path", "_part", "_run").sortWithinPartitions("path", "record").drop("_part", "_run")
    options = {"field": field, "upgrade": str(upgrade).lower(), "suffix": suffix, "part": str(part), "provenance": provenance, "stage": stage}
    try:
        done = checkpointed(ordered.mapInArrow(write, _COPIED))
        files = _file_a_task(done.groupBy("path", "part"))
        files.write.format("las").mode("append").options(**options).save(at)
    finally:
        discard_folder(place)


#: Columns of a section: a copy's, and a new file's.
_COPIED, _NEWS = (f"{keys}, run long, {_SECTION}" for keys in ("path string, part long", "file long"))


def _row(columns: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in columns.split(", "))])


def _file_a_task(files) -> DataFrame:
    """The grouped sections of files, in their order: a row and a task a file."""
    fields = ["run", *[c.split(" ")[0] for c in _SECTION.split(", ")]]
    rows = checkpointed(files.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("sections")))  # a section is SECTION records
    return rows.repartition(max(1, rows.count()))


def whole_offsets(points) -> tuple[float, float, float]:
    """The middle of the cloud's extent in whole units, from one aggregated row; 0 for an empty cloud."""
    row = points.agg(*[((F.min(c) + F.max(c)) / 2).alias(c) for c in "xyz"]).first()
    return tuple(float(np.rint(v)) if v is not None and np.isfinite(v) else 0.0 for v in row)


def _write_sections(ordered, at: str, each: int, scale: float, offsets: dict[str, str]) -> None:
    """Files of ``each`` partitions of ``ordered``, a section each."""
    place, schema = f"{at.rstrip('/')}/_sections-{uuid.uuid4().hex}", ordered.schema
    writer = LasWriter(at, schema, scale, True, tuple(float(offsets[f"offset_{c}"]) for c in "xyz"))

    def write(batches):
        run = TaskContext.get().partitionId()
        if found := writer.section(place, batches):
            yield pa.RecordBatch.from_pylist([{"file": run // each, "run": run} | found], _row(_NEWS))

    try:
        files = _file_a_task(checkpointed(ordered.mapInArrow(write, _NEWS)).groupBy("file"))
        files.write.format("las").mode("overwrite").option("scale", str(scale)).option("sections", schema.json()).options(**offsets).save(at)
    finally:
        discard_folder(place)


def write_classified(points, path: str, kind: str = "parquet", parts: int | None = None, scale: float = 0.001) -> None:
    """``points`` in the order of idx: ranges of idx, a file each, published together.

    LAS files share whole-unit offsets in the middle of the cloud; for that,
    ``points`` are stored first, so that a model behind them runs once. A
    range of more than ``SECTION`` points is sorted and written by several
    tasks, and then put together. What was in the folder goes when the new files are there.
    """
    points = checkpointed(points) if kind == "las" else points
    each = max(1, -(-points.count() // (parts * SECTION))) if kind == "las" and parts else 1
    ordered = points.repartitionByRange(parts * each, "idx") if parts else points.repartitionByRange("idx")
    ordered = ordered.sortWithinPartitions("idx")
    if kind == "las":
        register(points.sparkSession)
        offsets = {f"offset_{c}": str(v) for c, v in zip("xyz", whole_offsets(points), strict=True)}
        if each > 1:
            return _write_sections(ordered, qualified(points.sparkSession, path), each, scale, offsets)
        ordered.write.format("las").mode("overwrite").option("scale", str(scale)).options(**offsets).save(qualified(points.sparkSession, path))
    else:
        ordered.write.mode("errorifexists").format(kind).save(path)
