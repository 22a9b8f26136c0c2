"""GeoTIFFs put together from tiles that tasks encode.

A grid's tiles are encoded where their cells are and stored. A file's byte offsets are prefix sums of
the stored lengths, so the one task that puts it together only passes tiles on, in order: it never
holds a grid. The directory with all tags comes last in the file, and the file gets its name
after that, so a run that stops leaves nothing that looks complete.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import settled
from .raster import FORMS, SIZES

#: Fixed values of the format.
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8}
CLEAR, END, FULL = 256, 257, 4094
#: Files that would pass this size get 64-bit offsets.
CLASSIC_MOST = (1 << 32) - (1 << 16)


def pack_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, most significant bit first, that widen one code early."""
    out, held, bits, width, fresh = bytearray(), CLEAR, 9, 9, 258
    table: dict[int, int] = {}
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        held, bits = held << width | prefix, bits + width
        table[key] = fresh
        fresh += 1
        if fresh == FULL:
            held, bits = held << width | CLEAR, bits + width
            table, fresh, width = {}, 258, 9
        elif fresh == 1 << width:
            width += 1
        prefix = byte
        if bits >= 512:
            whole = bits // 8
            out += (held >> bits - 8 * whole).to_bytes(whole, "big")
            bits -= 8 * whole
            held &= (1 << bits) - 1
    if prefix >= 0:
        held, bits, fresh = held << width | prefix, bits + width, fresh + 1
        if fresh == FULL:
            held, bits, width = held << width | CLEAR, bits + width, 9
        elif fresh == 1 << width:
            width += 1
    held, bits = held << width | END, bits + width
    return bytes(out) + (held << -bits % 8).to_bytes(-(-bits // 8), "big")


def encode_block(values: np.ndarray, compression: str = "deflate", predictor: int = 1) -> bytes:
    """A block of a band, little-endian: differences along rows (2), or of the bytes of floating-point numbers by significance (3), then compressed."""
    values = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    rows, size = len(values), values.dtype.itemsize
    if predictor == 2:
        whole = values.view(f"<u{size}")
        data = np.concatenate([whole[:, :1], whole[:, 1:] - whole[:, :-1]], axis=1).tobytes()
    elif predictor == 3:
        if values.dtype.kind != "f":
            raise ValueError("predictor 3 is for floating-point numbers")
        raw = values.view(np.uint8).reshape(rows, -1, size)[:, :, ::-1].transpose(0, 2, 1).reshape(rows, -1)
        data = np.concatenate([raw[:, :1], raw[:, 1:] - raw[:, :-1]], axis=1).tobytes()
    else:
        data = values.tobytes()
    return zlib.compress(data, 6) if compression == "deflate" else pack_lzw(data) if compression == "lzw" else data


class Frame:
    """What all files of a run have in common: extent, place, type, tiles and how they are stored."""

    def __init__(self, height: int, width: int, transform: tuple, nodata: float | None = -9999.0, dtype: str = "<f4", tile: int = 256, compression: str = "deflate", predictor: int = 1):
        if compression not in COMPRESSIONS:
            raise ValueError(f"compression {compression} isn't one of {', '.join(COMPRESSIONS)}")
        if tile % 16:
            raise ValueError("sides of tiles are multiples of 16")
        self.height, self.width, self.transform, self.nodata = height, width, transform, nodata
        self.dtype, self.tile, self.compression, self.predictor = np.dtype(dtype), tile, compression, predictor
        self.across, self.down = -(-width // tile), -(-height // tile)

    def block(self, rows, cols, values) -> bytes:
        """The tile of the given places in it; other places, and missing values, are nodata."""
        fill = self.nodata if self.nodata is not None else np.nan if self.dtype.kind == "f" else 0
        own = np.full((self.tile, self.tile), fill, self.dtype)
        values = np.asarray(values, float)
        own[rows, cols] = np.where(np.isfinite(values), values, fill)
        return encode_block(own, self.compression, self.predictor)

    def empty(self) -> bytes:
        return self.block([], [], [])

    def head(self, size: int, big: bool) -> bytes:
        """The first bytes of a file whose directory begins at `size`."""
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, size) if big else struct.pack("<2sHI", b"II", 42, size)

    def directory(self, at: int, offsets: list[int], counts: list[int], tags: dict[str, str], big: bool) -> bytes:
        """The directory that stands at `at`, with its values behind it."""
        a, _, x, _, e, y = self.transform
        kind = {"u": 1, "i": 2, "f": 3}[self.dtype.kind]
        place = 16 if big else 4
        entries = [(256, 4, (self.width,)), (257, 4, (self.height,)), (258, 3, (8 * self.dtype.itemsize,)), (259, 3, (COMPRESSIONS[self.compression],)), (262, 3, (1,)), (277, 3, (1,)), (317, 3, (self.predictor,)), (322, 3, (self.tile,)), (323, 3, (self.tile,)), (339, 3, (kind,))]
        entries += [(33550, 12, (abs(a), abs(e), 0.0)), (33922, 12, (0.0, 0.0, 0.0, x, y, 0.0)), (324, place, offsets), (325, place, counts)]
        if tags:
            body = "".join(f"<Item name={quoteattr(k)}>{escape(v)}</Item>" for k, v in tags.items())
            entries.append((42112, 2, f"<GDALMetadata>{body}</GDALMetadata>".encode() + b"\0"))
        if self.nodata is not None:
            entries.append((42113, 2, f"{self.nodata:.17g}".encode() + b"\0"))
        held, number = (8, "Q") if big else (4, "I")
        behind, extra, out = at + (8 + 20 * len(entries) + 8 if big else 2 + 12 * len(entries) + 4), b"", b""
        for tag, form, value in sorted(entries, key=lambda t: t[0]):
            data = value if form == 2 else struct.pack(f"<{len(value)}{FORMS[form]}", *value)
            out += struct.pack(f"<HH{number}", tag, form, len(data) // SIZES[form])
            if len(data) <= held:
                out += data.ljust(held, b"\0")
            else:
                out += struct.pack(f"<{number}", behind + len(extra))
                extra += data + b"\0" * (-len(data) % 8)
        return struct.pack("<Q" if big else "<H", len(entries)) + out + bytes(held) + extra


class Writer:
    """One file: `put` its tiles in order, then `close`; nothing has the file's name before."""

    def __init__(self, uri: str, frame: Frame, lengths: dict[int, int], big: bool | None):
        files, self.path = pafs.FileSystem.from_uri(uri)
        self.files, self.frame, self.uri = files, frame, uri
        folder, name = self.path.rsplit("/", 1)
        files.create_dir(folder, recursive=True)
        n = frame.across * frame.down
        empty = frame.empty() if len(lengths) < n else b""
        total = sum(lengths.values()) + len(empty)
        self.big = total > CLASSIC_MOST if big is None else big
        at = len(frame.head(0, self.big))
        # Prefix sums of the stored lengths; places without a tile share one of nodata.
        self.offsets, self.counts = [0] * n, [len(empty)] * n
        for k in sorted(lengths):
            self.offsets[k], self.counts[k] = at, lengths[k]
            at += lengths[k]
        for k in range(n):
            self.offsets[k] = self.offsets[k] or at
        self.end, self.empty = at + len(empty), empty
        self.part = f"{folder}/.{name}-{uuid.uuid4().hex}.part"
        self.out = files.open_output_stream(self.part)
        self.out.write(frame.head(self.end + self.end % 2, self.big))
        self.at = len(frame.head(0, self.big))

    def put(self, tile: int, data: bytes) -> None:
        if self.at != self.offsets[tile] or len(data) != self.counts[tile]:
            raise ValueError(f"tile {tile} of {self.uri} isn't the one whose length was stored")
        self.out.write(data)
        self.at += len(data)

    def close(self, tags: dict[str, str]) -> None:
        self.out.write(self.empty + b"\0" * (self.end % 2))
        self.out.write(self.frame.directory(self.end + self.end % 2, self.offsets, self.counts, {**tags, "generation_complete": "true"}, self.big))
        self.out.close()
        self.files.move(self.part, self.path)


def assemble(tiles: DataFrame, keys: list[str], folder: str, name, frame: Frame, tags=None, big: bool | None = None) -> DataFrame:
    """Writes a file for each value of keys from encoded tiles (keys, tile, data, cells) under folder; the manifest (path, keys, cells), as it is written, so store it.

    name(*keys) gives the file's name, tags its further tags: a dict, or one from the keys. tiles is
    stored first. Places without a tile are nodata; cells are summed. big: 64-bit offsets always (or
    never), else only beyond 4 GiB.
    """
    tiles = settled(tiles)
    sizes = tiles.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("tile", F.octet_length("data").alias("n")))).alias("sizes"), F.sum("cells").alias("cells"))  # two numbers a tile
    first = sizes.select(*keys, F.lit(-1).alias("tile"), F.lit(None).cast("binary").alias("data"), "cells", "sizes")
    rest = tiles.select(*keys, "tile", "data", F.lit(None).cast("long").alias("cells"), F.lit(None).cast(sizes.schema["sizes"].dataType).alias("sizes"))
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    kinds = {f.name: f.dataType.simpleString() for f in tiles.schema}
    schema = "path string, " + ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", cells long"

    def run(batches):
        writer, key, cells, done = None, None, 0, []

        def end():
            writer.close(tags(*key) if callable(tags) else dict(tags or {}))
            done.append((writer.uri, *key, cells))

        for batch in batches:
            at = {n: batch.column(n) for n in batch.schema.names}
            for k in range(batch.num_rows):
                if at["tile"][k].as_py() < 0:
                    if writer:
                        end()
                    key = tuple(at[c][k].as_py() for c in keys)
                    cells = at["cells"][k].as_py()
                    writer = Writer(f"{uri}/{name(*key)}", frame, {x["tile"]: x["n"] for x in at["sizes"][k].as_py()}, big)
                else:
                    writer.put(at["tile"][k].as_py(), at["data"][k].as_py())
        if writer:
            end()
        if done:
            kinds_ = [batch.schema.field(c).type for c in keys]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.string(), *kinds_, pa.int64()))], names=["path", *keys, "cells"])

    ordered = first.unionByName(rest).repartition(*keys).sortWithinPartitions(*keys, "tile")
    return ordered.mapInArrow(run, schema)


def encode_tiles(grids: DataFrame, keys: list[str], frame: Frame) -> DataFrame:
    """(keys, tile, data, cells) of cells (keys, row, col, value): each tile encoded where its cells are."""
    t, across = frame.tile, frame.across
    kinds = {f.name: f.dataType.simpleString() for f in grids.schema}

    def run(own: pd.DataFrame) -> pd.DataFrame:
        data = frame.block(own["row"].to_numpy() % t, own["col"].to_numpy() % t, own["value"])
        return pd.DataFrame([[*own[keys].iloc[0].tolist(), int(own["tile"].iloc[0]), data, int(own["value"].notna().sum())]], columns=[*keys, "tile", "data", "cells"])

    rows = grids.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("value").cast("double").alias("value"))
    rows = rows.where(F.col("row").between(0, frame.height - 1) & F.col("col").between(0, frame.width - 1))
    tiled = rows.withColumn("tile", (F.floor(F.col("row") / t) * across + F.floor(F.col("col") / t)).cast("int"))
    return tiled.groupBy(*keys, "tile").applyInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tile int, data binary, cells long")


def write_grids(grids: DataFrame, folder: str, name, keys: list[str], height: int, width: int, transform: tuple, nodata: float | None = -9999.0, tags: dict[str, str] | None = None, dtype: str = "<f4", tile: int = 256, compression: str = "deflate", predictor: int = 1, big: bool | None = None) -> DataFrame:
    """Writes a file for each group of keys of grids (keys, row, col, value) under folder; the manifest (path, keys, cells), as it is written, so store it.

    Cells that a group lacks, and null ones, are nodata; cells outside height x width are left out;
    of cells that come twice one counts. An empty table writes nothing.
    """
    frame = Frame(height, width, transform, nodata, dtype, tile, compression, predictor)
    return assemble(encode_tiles(grids, keys, frame), keys, folder, name, frame, tags, big)


def to_geotiff(values: np.ndarray, transform: tuple, nodata: float | None = -9999.0, tags: dict[str, str] | None = None, tile: int = 256, compression: str = "deflate", predictor: int = 1, big: bool = False) -> bytes:
    """A tiled single-band file of a 2-D array; missing values become nodata."""
    values = np.asarray(values)
    dtype = values.dtype if values.dtype.kind != "f" else np.dtype("<f4" if values.dtype.itemsize <= 4 else "<f8")
    frame = Frame(*values.shape, transform, nodata, dtype.str, tile, compression, predictor)
    parts = [values[r : r + tile, c : c + tile] for r in range(0, frame.height, tile) for c in range(0, frame.width, tile)]
    blocks = [frame.block(*(x.ravel() for x in np.indices(p.shape)), p.ravel()) for p in parts]
    counts = list(map(len, blocks))
    first = len(frame.head(0, big))
    offsets = [first + sum(counts[:k]) for k in range(len(counts))]
    end = first + sum(counts)
    return frame.head(end + end % 2, big) + b"".join(blocks) + b"\0" * (end % 2) + frame.directory(end + end % 2, offsets, counts, tags or {}, big)
