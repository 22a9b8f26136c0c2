"""Cubes in HDF5 files, as NetCDF-4 writes them: dimensions from scales, chunks by either kind of index.

Read here: superblocks 0 to 3, object headers 1 and 2, groups by symbol table or compact links, compact
attributes, numbers and strings, contiguous, compact and chunked layouts (B-tree version 1, single
chunk, implicit and fixed-array indexes), the shuffle, deflate and checksum filters. What else a file
may hold (groups or attributes in dense storage, extensible arrays) is an error that names it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NOWHERE = (1 << 64) - 1
#: Kinds of header messages and filters.
SPACE, LINK_INFO, TYPE, FILL, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, TABLE, ATTRIBUTE_INFO = 1, 2, 3, 5, 6, 8, 11, 12, 16, 17, 21
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
TIME, LAT, LON = ("time", "t"), ("lat", "latitude", "y"), ("lon", "longitude", "x")


def _number(data: bytes, at: int = 0, n: int = 8) -> int:
    return int.from_bytes(data[at : at + n], "little")


class Kind:
    """A datatype message: numbers have a numpy type; strings, references and variable-length data are told apart."""

    def __init__(self, data: bytes):
        self.form, bits, self.size = data[0] & 15, _number(data, 1, 3), _number(data, 4, 4)
        order = ">" if bits & 1 else "<"
        self.dtype = np.dtype(f"{order}{'i' if bits & 8 else 'u'}{self.size}") if self.form == 0 else np.dtype(f"{order}f{self.size}") if self.form == 1 else None
        self.text = self.form == 3 or self.form == 9 and bits & 15 == 1
        self.base = Kind(data[8:]) if self.form == 9 else None


def _space(data: bytes) -> tuple[int, ...]:
    n = data[1]
    at = 8 if data[0] == 1 else 4
    return tuple(_number(data, at + 8 * k) for k in range(n))


class Dataset:
    """One dataset's shape, type, place of its data and attributes."""

    def __init__(self, file: File, address: int):
        self.file, self.address = file, address
        self.attrs, self.shape, self.kind, self.layout, self.filters, self.fill = {}, None, None, None, [], None
        for form, data in file.messages(address):
            if form == SPACE:
                self.shape = _space(data)
            elif form == TYPE:
                self.kind = Kind(data)
            elif form == LAYOUT:
                self.layout = data
            elif form == FILTERS:
                self.filters = _filters(data)
            elif form == FILL:
                self.fill = _fill(data)
            elif form == ATTRIBUTE:
                name, value = file.attribute(data)
                self.attrs[name] = value
            elif form == ATTRIBUTE_INFO and _number(data, 2 + (2 if data[1] & 1 else 0)) != NOWHERE:
                raise ValueError("attributes in dense storage aren't read")

    @property
    def dtype(self) -> np.dtype:
        if self.kind is None or self.kind.dtype is None:
            raise ValueError("a dataset of numbers is needed")
        return self.kind.dtype

    def chunk_shape(self) -> tuple[int, ...] | None:
        d, n = self.layout, len(self.shape)
        if d[0] == 3 and d[1] == 2:
            return tuple(_number(d, 11 + 4 * k, 4) for k in range(n))
        if d[0] == 4 and d[1] == 2:
            width = d[4]
            return tuple(_number(d, 5 + width * k, width) for k in range(n))
        return None

    def chunks(self, first: int, last: int):
        """(offsets, address, stored size, filter mask) of chunks that touch steps first..last - 1 of the first dimension."""
        d, n, chunk = self.layout, len(self.shape), self.chunk_shape()
        whole = int(np.prod(chunk, dtype=np.int64)) * self.dtype.itemsize
        if d[0] == 3:
            yield from self._tree(_number(d, 3), first, last)
            return
        width, flags = d[4], d[2]
        at = 5 + width * (n + 1)
        index, at = d[at], at + 1
        counts = [-(-s // c) for s, c in zip(self.shape, chunk)]
        places = lambda k: tuple(int(i) * c for i, c in zip(np.unravel_index(k, counts), chunk))
        touches = lambda o: o[0] < last and o[0] + chunk[0] > first
        if index == 1:
            size, mask = (_number(d, at), _number(d, at + 8, 4)) if flags & 2 else (whole, 0)
            found = [(_number(d, at + 12 if flags & 2 else at), size, mask)]
        elif index == 2:
            base = _number(d, at)
            found = [(base + k * whole, whole, 0) for k in range(int(np.prod(counts)))]
        elif index == 3:
            found = self._fixed(_number(d, at + 1), whole)
        else:
            raise ValueError(f"chunk index {index} isn't read; rewrite the file without an unlimited dimension or in the older format")
        for k, (address, size, mask) in enumerate(found):
            if address != NOWHERE and touches(places(k)):
                yield places(k), address, size, mask

    def _tree(self, address: int, first: int, last: int):
        """Leaves of a version-1 B-tree; its keys are in order of the first dimension, so other branches aren't read."""
        if address == NOWHERE:
            return
        n, chunk = len(self.shape), self.chunk_shape()
        head = self.file.read(24, address)
        if head[:4] != b"TREE" or head[4] != 1:
            raise ValueError("no tree of chunks where the layout points")
        used, key = _number(head, 6, 2), 8 + 8 * (n + 1)
        data = self.file.read(used * (key + 8) + key, address + 24)
        keys = [tuple(_number(data, k * (key + 8) + 8 + 8 * j) for j in range(n)) for k in range(used + 1)]
        for k in range(used):
            at = k * (key + 8)
            child = _number(data, at + key)
            if head[5]:
                if keys[k][0] < last and keys[k + 1][0] + chunk[0] > first:
                    yield from self._tree(child, first, last)
            elif keys[k][0] < last and keys[k][0] + chunk[0] > first:
                yield keys[k], child, _number(data, at, 4), _number(data, at + 4, 4)

    def _fixed(self, address: int, whole: int) -> list[tuple[int, int, int]]:
        """(address, size, mask) of all chunks of a fixed array, in order, paged or not."""
        head = self.file.read(28, address)
        if head[:4] != b"FAHD":
            raise ValueError("no fixed array where the layout points")
        filtered, entry, bits, n, block = head[5] == 1, head[6], head[7], _number(head, 8), _number(head, 16)
        if block == NOWHERE:
            return [(NOWHERE, 0, 0)] * n
        size = entry - 12
        told = lambda d, k: (_number(d, k * entry), _number(d, k * entry + 8, size), _number(d, k * entry + 8 + size, 4)) if filtered else (_number(d, k * entry), whole, 0)
        at, page = block + 14, 1 << bits
        if n <= page:
            data = self.file.read(n * entry, at)
            return [told(data, k) for k in range(n)]
        pages = -(-n // page)
        made = self.file.read(-(-pages // 8), at)
        at += len(made) + 4
        out = []
        for p in range(pages):
            many = min(page, n - p * page)
            if made[p // 8] >> (7 - p % 8) & 1:
                data = self.file.read(many * entry, at)
                out += [told(data, k) for k in range(many)]
            else:
                out += [(NOWHERE, 0, 0)] * many
            at += page * entry + 4
        return out

    def plain(self, data: bytes, mask: int) -> bytes:
        """A stored chunk with its filters undone, last first; bits of mask are filters that were left out."""
        for k, (form, values) in reversed(list(enumerate(self.filters))):
            if mask >> k & 1:
                continue
            if form == DEFLATE:
                data = zlib.decompress(data)
            elif form == SHUFFLE:
                size = values[0] if values else self.dtype.itemsize
                n = len(data) // size
                data = np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]
            elif form == CHECKSUM:
                data = data[:-4]
            else:
                raise ValueError(f"filter {form} isn't known")
        return data

    def rows(self, first: int, last: int) -> np.ndarray:
        """Values of steps first..last - 1 of the first dimension; chunks that were never written have the fill value."""
        shape = (last - first, *self.shape[1:])
        each = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize
        d = self.layout
        if d[0] not in (3, 4):
            raise ValueError(f"layout version {d[0]} isn't read")
        if d[1] == 0:
            n = _number(d, 2, 2)
            return np.frombuffer(d[4 : 4 + n], self.dtype).reshape(self.shape)[first:last]
        fill = np.frombuffer(self.fill, self.dtype)[0] if self.fill and len(self.fill) == self.dtype.itemsize else 0
        if d[1] == 1:
            address = _number(d, 2)
            if address == NOWHERE:
                return np.full(shape, fill, self.dtype)
            return np.frombuffer(self.file.read(each * (last - first), address + each * first), self.dtype).reshape(shape)
        out, chunk = np.full(shape, fill, self.dtype), self.chunk_shape()
        for offsets, address, size, mask in self.chunks(first, last):
            values = np.frombuffer(self.plain(self.file.read(size, address), mask), self.dtype, int(np.prod(chunk, dtype=np.int64))).reshape(chunk)
            low = [max(offsets[0], first), *offsets[1:]]
            high = [min(o + c, s) for o, c, s in zip(offsets, chunk, (last, *self.shape[1:]))]
            to = tuple(slice(a - (first if k == 0 else 0), b - (first if k == 0 else 0)) for k, (a, b) in enumerate(zip(low, high)))
            out[to] = values[tuple(slice(a - o, b - o) for a, b, o in zip(low, high, offsets))]
        return out


def _filters(data: bytes) -> list[tuple[int, list[int]]]:
    out, at = [], 8 if data[0] == 1 else 2
    for _ in range(data[1]):
        form = _number(data, at, 2)
        named = data[0] == 1 or form >= 256
        length = _number(data, at + 2, 2) if named else 0
        at += 4 if named else 2
        n = _number(data, at + 2, 2)
        at += 4 + (length + -length % 8 if data[0] == 1 else length)
        out.append((form, [_number(data, at + 4 * k, 4) for k in range(n)]))
        at += 4 * (n + (n % 2 if data[0] == 1 else 0))
    return out


def _fill(data: bytes) -> bytes | None:
    if data[0] in (1, 2):
        return data[8 : 8 + _number(data, 4, 4)] if data[0] == 1 or data[3] else None
    return data[6 : 6 + _number(data, 2, 4)] if data[1] & 0x20 else None


class File:
    """Datasets of the root group by name."""

    def __init__(self, f):
        self.f = f
        head = f.read_at(96, 0)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        old = head[8] < 2
        if (head[13:15] if old else head[9:11]) != b"\x08\x08":
            raise ValueError("only files with addresses and lengths of eight bytes")
        root = _number(head, (24 if head[8] == 0 else 28) + 32 + 8) if old else _number(head, 36)
        self.heaps: dict[int, dict[int, bytes]] = {}
        self.links = self._links(root)
        self.data = {name: Dataset(self, at) for name, at in self.links.items() if any(form == SPACE for form, _ in self.messages(at))}

    def read(self, n: int, at: int) -> bytes:
        data = self.f.read_at(n, at)
        if len(data) < n:
            raise ValueError("file ends too early")
        return data

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        head, out = self.read(16, address), []
        if head[:4] == b"OHDR":
            flags = head[5]
            at = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            wide = 1 << (flags & 3)
            size = _number(self.read(wide, address + at), 0, wide)
            blocks, step = [(address + at + wide, size)], 6 if flags & 4 else 4
            while blocks:
                place, size = blocks.pop(0)
                data, k = self.read(size, place), 0
                while k + step <= len(data):
                    form, n, body = data[k], _number(data, k + 1, 2), k + step
                    self._take(form, data[body : body + n], out, blocks, 8)
                    k = body + n
            return out
        if head[0] != 1:
            raise ValueError(f"object header version {head[0]} isn't read")
        blocks = [(address + 16, _number(head, 8, 4))]
        while blocks:
            place, size = blocks.pop(0)
            data, k = self.read(size, place), 0
            while k + 8 <= len(data):
                form, n = _number(data, k, 2), _number(data, k + 2, 2)
                self._take(form, data[k + 8 : k + 8 + n], out, blocks, 0)
                k += 8 + n
        return out

    def _take(self, form: int, body: bytes, out: list, blocks: list, around: int) -> None:
        """A message, or a block of more; blocks of version 2 have a name of four bytes before and a checksum behind."""
        if form == CONTINUED:
            at, size = _number(body), _number(body, 8)
            blocks.append((at + around // 2, size - around))
        else:
            out.append((form, body))

    def _links(self, address: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for form, data in self.messages(address):
            if form == TABLE:
                heap = self.read(32, _number(data, 8))
                names = self.read(_number(heap, 8), _number(heap, 24))
                self._table(_number(data), names, out)
            elif form == LINK:
                flags, at = data[1], 2
                kind = data[at] if flags & 8 else 0
                at += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                wide = 1 << (flags & 3)
                n, at = _number(data, at, wide), at + wide
                if kind == 0:
                    out[data[at : at + n].decode()] = _number(data, at + n)
            elif form == LINK_INFO and _number(data, 2 + (8 if data[1] & 1 else 0)) != NOWHERE:
                raise ValueError("groups in dense storage (more than eight members) aren't read")
        return out

    def _table(self, address: int, names: bytes, out: dict[str, int]) -> None:
        head = self.read(24, address)
        if head[:4] == b"TREE":
            used = _number(head, 6, 2)
            data = self.read(16 * used + 8, address + 24)
            for k in range(used):
                self._table(_number(data, 8 + 16 * k), names, out)
            return
        n = _number(head, 6, 2)
        data = self.read(40 * n, address + 8)
        for k in range(n):
            at = _number(data, 40 * k)
            out[names[at : names.index(b"\0", at)].decode()] = _number(data, 40 * k + 8)

    def attribute(self, data: bytes):
        version, sizes = data[0], [_number(data, k, 2) for k in (2, 4, 6)]
        at, pads = 8 if version < 3 else 9, []
        for n in sizes:
            pads.append(data[at : at + n])
            at += n + (-n % 8 if version == 1 else 0)
        name, kind, shape = pads[0].rstrip(b"\0").decode(), Kind(pads[1]), _space(pads[2])
        n, raw = int(np.prod(shape, dtype=np.int64)), data[at:]
        if kind.form == 9:
            found = [self._heaped(raw[16 * k : 16 * k + 16]) for k in range(n)]
            return name, [x.decode() for x in found] if kind.text and n > 1 else found[0].decode() if kind.text and n else found
        if kind.text:
            return name, raw[: kind.size].split(b"\0")[0].decode("utf-8", "replace")
        return name, np.frombuffer(raw, kind.dtype, n) if kind.dtype is not None else raw

    def _heaped(self, place: bytes) -> bytes:
        """An object of a global heap by its place (length, address, number)."""
        address, number = _number(place, 4), _number(place, 12, 4)
        if address not in self.heaps:
            size = _number(self.read(16, address), 8)
            data, at, own = self.read(size, address), 16, {}
            while at + 16 <= size:
                k, n = _number(data, at, 2), _number(data, at + 8)
                if k == 0:
                    break
                own[k] = data[at + 16 : at + 16 + n]
                at += 16 + n + -n % 8
            self.heaps[address] = own
        return self.heaps[address][number]

    # --- the same face as a classic header has -----------------------------------------------------

    def dims(self, name: str) -> list[str]:
        """Names of a dataset's dimensions: its scales', or its own if it is one."""
        d, by_place = self.data[name], {at: n for n, at in self.links.items()}
        held = d.attrs.get("DIMENSION_LIST")
        if held is not None:
            return [by_place.get(_number(x), "") for x in held]
        return [name] if len(d.shape or ()) == 1 else [""] * len(d.shape or ())

    def field(self) -> str:
        """The only dataset over time, latitude and longitude."""
        found = [n for n in self.data if len(s := {x.lower() for x in self.dims(n)}) == 3 and all(s & set(x) for x in (TIME, LAT, LON))]
        if len(found) != 1:
            raise ValueError(f"needs one variable over time, lat and lon, has {found}")
        return found[0]

    def length(self) -> int:
        name = self.field()
        return next(n for n, d in zip(self.data[name].shape, self.dims(name)) if d.lower() in TIME)

    def axis(self, names) -> np.ndarray | None:
        for n, d in self.data.items():
            if n.lower() in names and len(d.shape) == 1:
                return d.rows(0, d.shape[0]).astype(float)
        return None

    def times(self) -> tuple[np.ndarray | None, str, str]:
        for n, d in self.data.items():
            if n.lower() in TIME and len(d.shape) == 1:
                return d.rows(0, d.shape[0]), str(d.attrs.get("units", "")), str(d.attrs.get("calendar", "standard"))
        return None, "", "standard"

    def run(self) -> int:
        """Steps of time that chunks hold together; 1 if the field isn't chunked along time."""
        name = self.field()
        chunk = self.data[name].chunk_shape()
        return chunk[0] if chunk and self.dims(name)[0].lower() in TIME else 1

    def steps(self, name: str, first: int, last: int) -> np.ndarray:
        """(time, lat, lon) of steps first..last - 1; missing and fill values are NaN."""
        d, dims = self.data[name], [x.lower() for x in self.dims(name)]
        order = [next(i for i, x in enumerate(dims) if x in names) for names in (TIME, LAT, LON)]
        values = d.rows(first, last) if order[0] == 0 else np.take(d.rows(0, d.shape[0]), range(first, last), order[0])
        values = np.transpose(values, order)
        out = values.astype(np.float64)
        for key in ("_FillValue", "missing_value"):
            if key in d.attrs and len(d.attrs[key]):
                out[values == d.attrs[key][0]] = np.nan
        scale, shift = (float(d.attrs[k][0]) if k in d.attrs else v for k, v in (("scale_factor", 1.0), ("add_offset", 0.0)))
        return out * scale + shift if (scale, shift) != (1.0, 0.0) else out
