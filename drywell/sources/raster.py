"""GeoTIFFs as rows: windows of pixels, geometry and tags.

Files with strips or tiles, stored plain, by deflate or by LZW, with or without the horizontal or the
floating-point predictor. `assembly` writes them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import listing, opened

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
FORMS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {(8, 1): "<u1", (16, 1): "<u2", (32, 1): "<u4", (8, 2): "<i1", (16, 2): "<i2", (32, 2): "<i4", (32, 3): "<f4", (64, 3): "<f8"}
PIXELS = "path string, row int, col int, value double"


def unpack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> bits - width & (1 << width) - 1
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
                continue
            piece = table[code] if code < len(table) else last + last[:1]
            out.append(piece)
            if last:
                table.append(last + piece[:1])
            last = piece
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


class Raster:
    """One file's first image; blocks(rows) reads only what it touches. Classic and BigTIFF, either byte order, bands together or apart."""

    def __init__(self, f):
        self.f = f
        head = f.read_at(16, 0)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        version = struct.unpack_from(f"{self.order or '<'}H", head, 2)[0]
        if not self.order or version not in (42, 43):
            raise ValueError("not a TIFF file")
        big, e = version == 43, self.order
        at, = struct.unpack_from(f"{e}Q" if big else f"{e}I", head, 8 if big else 4)
        n, = struct.unpack(f"{e}Q" if big else f"{e}H", f.read_at(8 if big else 2, at))
        one, held = (20, 8) if big else (12, 4)
        raw, self.tags = f.read_at(one * n, at + (8 if big else 2)), {}
        for k in range(n):
            tag, kind = struct.unpack_from(f"{e}HH", raw, one * k)
            count, = struct.unpack_from(f"{e}Q" if big else f"{e}I", raw, one * k + 4)
            size, place = SIZES.get(kind, 1) * count, one * k + one - held
            data = raw[place : place + size] if size <= held else f.read_at(size, struct.unpack_from(f"{e}Q" if big else f"{e}I", raw, place)[0])
            self.tags[tag] = data.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else struct.unpack(f"{e}{count}{FORMS[kind]}", data) if kind in FORMS else data
        one = lambda t, d=None: self.tags[t][0] if t in self.tags else d
        self.width, self.height = one(256), one(257)
        self.dtype = np.dtype(KINDS[one(258, 8), one(339, 1)]).newbyteorder(self.order)
        self.compression, self.predictor = one(259, 1), one(317, 1)
        self.bands, self.apart = one(277, 1), one(284, 1) == 2
        self.tiled = 322 in self.tags
        self.bw, self.bh = (one(322), one(323)) if self.tiled else (self.width, min(one(278, self.height), self.height))
        self.offsets, self.counts = (self.tags[324], self.tags[325]) if self.tiled else (self.tags[273], self.tags[279])
        text = self.tags.get(42113)
        self.nodata = float(text) if text else None
        sx, sy = self.tags[33550][:2] if 33550 in self.tags else (1.0, 1.0)
        i, j, _, x, y, _ = self.tags.get(33922, (0.0,) * 6)
        self.transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)

    def block(self, k: int, rows: int) -> np.ndarray:
        """(rows, columns, bands that are stored together)."""
        data = self.f.read_at(self.counts[k], self.offsets[k])
        if self.compression in (8, 32946):
            data = zlib.decompress(data)
        elif self.compression == 5:
            data = unpack_lzw(data)
        elif self.compression != 1:
            raise ValueError(f"compression {self.compression} isn't supported")
        together, size = 1 if self.apart else self.bands, self.dtype.itemsize
        shape = (rows, self.bw, together)
        if self.predictor == 3:  # bytes of a row by significance, the most significant first whatever the file's order
            raw = np.frombuffer(data, np.uint8, rows * self.bw * together * size).reshape(rows, -1, together)
            raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, -1)
            return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(shape)
        out = np.frombuffer(data, self.dtype, rows * self.bw * together).reshape(shape)
        if self.predictor == 2:
            whole = out.view(f"{self.order}u{size}")
            out = np.cumsum(whole, axis=1, dtype=np.dtype(f"u{size}")).view(self.dtype.newbyteorder("="))
        return out

    def blocks(self, row0: int = 0, row1: int | None = None, band: int = 1):
        """(first row, first column, values of a band, from 1) of the blocks that touch rows row0..row1 - 1."""
        if not 1 <= band <= self.bands:
            raise ValueError(f"band {band} of {self.bands}")
        row1 = self.height if row1 is None else min(row1, self.height)
        across, down = -(-self.width // self.bw), -(-self.height // self.bh)
        first, layer = (across * down * (band - 1), 0) if self.apart else (0, band - 1)
        for r in range(row0 // self.bh, -(-row1 // self.bh)):
            for c in range(across):
                rows = self.bh if self.tiled else min(self.bh, self.height - r * self.bh)
                values = self.block(first + r * across + c, rows)[: self.height - r * self.bh, : self.width - c * self.bw, layer]
                a, b = max(row0 - r * self.bh, 0), row1 - r * self.bh
                yield r * self.bh + a, c * self.bw, values[a:b]


def pixels(spark: SparkSession, path: str, glob: str = "*.tif", row0: int = 0, row1: int | None = None, band: int = 1) -> DataFrame:
    """(path, row, col, value) of a band of rasters, a batch per block; nodata and NaN are null."""
    return pixels_of(listing(spark, path, glob).select("path"), row0, row1, band)


def pixels_of(paths: DataFrame, row0: int = 0, row1: int | None = None, band: int = 1) -> DataFrame:
    """The same of a table of paths, which may name members of archives (`files.member_path`). Reads that fail are tried again."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with opened(uri) as f:
                    raster = Raster(f)
                    for r, c, values in raster.blocks(row0, row1, band):
                        v = values.astype(np.float64)
                        bad = ~np.isfinite(v)
                        if raster.nodata is not None:
                            bad |= np.isclose(v, raster.nodata)
                        row, col = np.indices(v.shape)
                        yield pa.RecordBatch.from_arrays([pa.array([uri] * v.size), pa.array((row + r).ravel().astype(np.int32)), pa.array((col + c).ravel().astype(np.int32)), pa.array(v.ravel(), mask=bad.ravel())], names=["path", "row", "col", "value"])

    return paths.select("path").mapInArrow(run, PIXELS)


INVENTORY = "path string, size_bytes long, width int, height int, transform_a double, transform_b double, transform_c double, transform_d double, transform_e double, transform_f double, pixel_size_x double, pixel_size_y double, nodata double, dtype string, compression string, tags map<string,string>"


def inventory(spark: SparkSession, path: str, glob: str = "*.tif") -> DataFrame:
    """A row of geometry, type and tags for each raster, from headers only."""
    import xml.etree.ElementTree as ET

    def run(batches):
        for batch in batches:
            rows = []
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with opened(uri) as f:
                    r = Raster(f)
                text = r.tags.get(42112)
                tags = {x.get("name"): x.text or "" for x in ET.fromstring(text)} if text else {}
                rows.append((uri, size, r.width, r.height, *r.transform, abs(r.transform[0]), abs(r.transform[4]), r.nodata, r.dtype.name, {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate"}.get(r.compression, str(r.compression)), list(tags.items())))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 9, pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in INVENTORY.split(", ")])

    return listing(spark, path, glob).mapInArrow(run, INVENTORY)


def scaled(value, nodata: float = -99999.0, factor: float = 0.0001):
    """Integer bands to values: nodata is null, the rest times the factor."""
    from ..functions.clean import without

    return without(value, nodata) * factor
