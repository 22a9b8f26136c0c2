"""HDF5 cubes made here, in the older and the newer form, against the same cube in classic form."""

import struct
import zlib

import numpy as np
import pytest

from drywell.sources import cube, hdf5

from .test_sources import classic_netcdf

NONE = hdf5.NOWHERE
U = struct.Struct("<Q").pack


def pad8(b):
    return b + b"\0" * (-len(b) % 8)


def kind(dtype):
    """A datatype message."""
    d = np.dtype(dtype)
    big = int(d.byteorder == ">")
    if d.kind == "f":
        exp, man, bias = (8, 23, 127) if d.itemsize == 4 else (11, 52, 1023)
        return struct.pack("<BBBBI", 0x11, 0x20 | big, d.itemsize * 8 - 1, 0, d.itemsize) + struct.pack("<HHBBBBI", 0, d.itemsize * 8, man, exp, 0, man, bias)
    return struct.pack("<BBBBI", 0x10, big | (8 if d.kind == "i" else 0), 0, 0, d.itemsize) + struct.pack("<HH", 0, d.itemsize * 8)


def text_kind(n):
    return struct.pack("<BBBBI", 0x13, 0, 0, 0, n)


REFS = struct.pack("<BBBBI", 0x19, 0, 0, 0, 16) + struct.pack("<BBBBI", 0x17, 0, 0, 0, 8)


def space(shape):
    return struct.pack("<BBBBI", 1, len(shape), 0, 0, 0) + b"".join(map(U, shape))


def attribute(name, form, shape, data, new):
    n = name.encode() + b"\0"
    s = struct.pack("<BBBB", 2, len(shape), 0, 1 if shape else 0) + b"".join(map(U, shape)) if new else space(shape)
    if new:
        return struct.pack("<BBHHHB", 3, 0, len(n), len(form), len(s), 0) + n + form + s + data
    return struct.pack("<BBHHH", 1, 0, len(n), len(form), len(s)) + pad8(n) + pad8(form) + pad8(s) + data


class Build:
    """Bytes of a file; `new` has version-2 headers, compact links and fixed arrays, else tables, version-1 headers and trees."""

    def __init__(self, new):
        self.new, self.out = new, bytearray(b"\0" * 96)

    def put(self, data):
        self.out += b"\0" * (-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def header(self, messages, split=False):
        """An object header; split puts the last message into a continuation."""
        rest = b""
        if self.new:
            each = [struct.pack("<BHB", form, len(m), 0) + m for form, m in messages]
            if split:
                block = b"OCHK" + each.pop() + bytes(4)
                rest = struct.pack("<BHB", 16, 16, 0) + U(self.put(block)) + U(len(block))
            body = b"".join(each) + rest
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4))
        each = [struct.pack("<HHBBBB", form, len(pad8(m)), 0, 0, 0, 0) + pad8(m) for form, m in messages]
        if split:
            block = each.pop()
            rest = struct.pack("<HHBBBB", 16, 16, 0, 0, 0, 0) + U(self.put(block)) + U(len(block))
        body = b"".join(each) + rest
        return self.put(struct.pack("<BBHIII", 1, 0, len(messages), 1, len(body), 0) + body)

    def chunked(self, values, chunk, filters, skip=(), page_bits=10):
        """The layout message of a stored array; chunks in skip are never written."""
        counts = [-(-s // c) for s, c in zip(values.shape, chunk)]
        stored = []
        for k in range(int(np.prod(counts))):
            at = [int(i) * c for i, c in zip(np.unravel_index(k, counts), chunk)]
            own = np.full(chunk, 7, values.dtype)
            part = values[tuple(slice(a, a + c) for a, c in zip(at, chunk))]
            own[tuple(map(slice, part.shape))] = part
            data, mask = own.tobytes(), 0
            for j, f in enumerate(filters):
                if f == hdf5.SHUFFLE:
                    data = np.frombuffer(data, np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()
                elif f == hdf5.DEFLATE and k % 5 == 3:
                    mask |= 1 << j  # a chunk that left the filter out
                elif f == hdf5.DEFLATE:
                    data = zlib.compress(data)
                elif f == hdf5.CHECKSUM:
                    data += bytes(4)
            stored.append((at, NONE if k in skip else self.put(data), len(data), mask))
        item = values.dtype.itemsize
        if not self.new:
            key = lambda at, size=0, mask=0: struct.pack("<II", size, mask) + b"".join(map(U, [*at, 0]))
            def node(level, children, end):
                body = b"".join(k + U(a) for k, a in children) + end
                return self.put(b"TREE" + struct.pack("<BBH", 1, level, len(children)) + U(NONE) * 2 + body)
            kept = [s for s in stored if s[1] != NONE]
            groups, last = [kept[k : k + 3] for k in range(0, len(kept), 3)], key([values.shape[0] + chunk[0]] + [0] * (values.ndim - 1))
            leaves = []
            for k, g in enumerate(groups):
                end = key(groups[k + 1][0][0]) if k + 1 < len(groups) else last
                leaves.append((key(*[g[0][0], g[0][2], g[0][3]]), node(0, [(key(at, n, m), a) for at, a, n, m in g], end)))
            return struct.pack("<BBB", 3, 2, values.ndim + 1) + U(node(1, leaves, last)) + struct.pack(f"<{values.ndim + 1}I", *chunk, item)
        if filters:
            entry, cells = 8 + 4 + 4, [U(a) + struct.pack("<II", n, m) for _, a, n, m in stored]
        else:
            entry, cells = 8, [U(a) for _, a, _, _ in stored]
        page = 1 << page_bits
        if len(cells) <= page:
            body = b"".join(cells) + bytes(4)
        else:
            pages = [cells[k : k + page] for k in range(0, len(cells), page)]
            bits = np.packbits([any(c[:8] != U(NONE) for c in p) for p in pages]).tobytes()
            body = bits + bytes(4) + b"".join(b"".join(p) + bytes(4) for p in pages)
        block = self.put(b"FADB" + struct.pack("<BB", 0, int(bool(filters))) + U(0) + body)
        head = self.put(b"FAHD" + struct.pack("<BBBB", 0, int(bool(filters)), entry, page_bits) + U(len(cells)) + U(block) + bytes(4))
        return struct.pack("<BBBBB", 4, 2, 0, values.ndim + 1, 4) + struct.pack(f"<{values.ndim + 1}I", *chunk, item) + struct.pack("<BB", 3, page_bits) + U(head)

    def filters(self, ids, item):
        out = struct.pack("<BB", 2 if self.new else 1, len(ids)) + (b"" if self.new else bytes(6))
        for f in ids:
            v = {hdf5.SHUFFLE: [item], hdf5.DEFLATE: [6], hdf5.CHECKSUM: []}[f]
            out += struct.pack("<HHH", f, 0, len(v)) if self.new else struct.pack("<HHHH", f, 0, 0, len(v))
            out += struct.pack(f"<{len(v)}I", *v) + (bytes(4) if len(v) % 2 and not self.new else b"")
        return out

    def dataset(self, values, attrs=(), chunk=None, filters=(), fill=None, split=False, **more):
        layout = self.chunked(values, chunk, filters, **more) if chunk else struct.pack("<BB", 3, 1) + U(self.put(values.tobytes())) + U(values.nbytes)
        messages = [(1, space(values.shape)), (3, kind(values.dtype)), (8, layout)]
        if filters:
            messages.append((11, self.filters(filters, values.dtype.itemsize)))
        if fill is not None:
            v = np.array(fill, values.dtype).tobytes()
            messages.append((5, struct.pack("<BBI", 3, 0x20, len(v)) + v if self.new else struct.pack("<BBBBI", 2, 1, 0, 1, len(v)) + v))
        return self.header(messages + [(12, attribute(*a, self.new)) for a in attrs], split)

    def finish(self, members):
        if self.new:
            root = self.header([(6, struct.pack("<BBB", 1, 0, len(n)) + n.encode() + U(at)) for n, at in members.items()])
            self.out[:48] = hdf5.SIGNATURE + struct.pack("<BBBB", 2, 8, 8, 0) + U(0) + U(NONE) + U(len(self.out)) + U(root) + bytes(4)
            return bytes(self.out)
        names, places = bytearray(8), {}
        for n in sorted(members):
            places[n] = len(names)
            names += pad8(n.encode() + b"\0")
        heap = self.put(b"HEAP" + bytes(4) + U(len(names)) + U(NONE) + U(self.put(bytes(names))))
        table = self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(members)) + b"".join(U(places[n]) + U(members[n]) + bytes(24) for n in sorted(members)))
        tree = self.put(b"TREE" + struct.pack("<BBH", 0, 0, 1) + U(NONE) * 2 + U(0) + U(table) + U(places[max(places)]))
        root = self.header([(17, U(tree) + U(heap))])
        self.out[:96] = hdf5.SIGNATURE + bytes(5) + b"\x08\x08\0" + struct.pack("<HHI", 4, 16, 0) + U(0) + U(NONE) + U(len(self.out)) + U(NONE) + U(0) + U(root) + bytes(24)
        return bytes(self.out)


def hdf5_cube(values, new, lats, lons, name="temp", fill=-999.0, dims=("time", "lat", "lon"), units="days since 2000-01-31", **form):
    b = Build(new)
    axes = {"time": np.arange(values.shape[dims.index("time")], dtype="<i4") * 30, "lat": np.array(lats, "<f4"), "lon": np.array(lons, "<f8")}
    words = lambda k, v: (k, text_kind(len(v)), (), v.encode())
    members = {n: b.dataset(v, [words("units", units), words("calendar", "noleap")] if n == "time" else [], split=n == "time") for n, v in axes.items()}
    objects = b"".join(struct.pack("<HHIQ", k + 1, 1, 0, 8) + U(members[n]) for k, n in enumerate(dims))
    heap = b.put(b"GCOL" + bytes([1, 0, 0, 0]) + U(16 + len(objects) + 16) + objects + bytes(16))
    listed = b"".join(struct.pack("<IQI", 1, heap, k + 1) for k in range(3))
    stored = np.where(np.isnan(values), fill, values).astype("<f4")
    members[name] = b.dataset(stored, [("_FillValue", kind("<f4"), (1,), struct.pack("<f", fill)), ("DIMENSION_LIST", REFS, (3,), listed)], fill=fill, **form)
    return b.finish(members)


def values_of(shape=(31, 5, 7)):
    out = np.random.default_rng(8).normal(0, 1, shape).astype(np.float32).astype(float)
    out[3, 1, 2] = np.nan
    return out


@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("form", [{}, {"chunk": (4, 3, 3)}, {"chunk": (4, 3, 3), "filters": (hdf5.SHUFFLE, hdf5.DEFLATE, hdf5.CHECKSUM)}, {"chunk": (1, 5, 7), "filters": (hdf5.DEFLATE,), "page_bits": 2}])
def test_equal_the_classic_cube(spark, tmp_path, new, form):
    values = values_of()
    (tmp_path / "a.nc").write_bytes(classic_netcdf(values))
    (tmp_path / "b.nc").write_bytes(hdf5_cube(values, new, range(5), range(7), **form))
    a, b = (cube.read_cube(spark, str(tmp_path / n), 31) for n in ("a.nc", "b.nc"))
    assert b.count() == values.size and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    told = cube.describe(str(tmp_path / "b.nc"))
    assert (told.name, told.lats, told.lons[-1], told.dates[:3]) == ("temp", [0, 1, 2, 3, 4], 6.0, [(2000, 1, 31), (2000, 3, 2), (2000, 4, 1)])
    some = cube.read_cube(spark, str(tmp_path / "b.nc"), first=13, last=21)
    assert {r["t"] for r in some.select("t").distinct().collect()} == set(range(13, 21))
    assert some.exceptAll(a.where("t BETWEEN 13 AND 20")).isEmpty() and some.count() == 8 * 35
    assert cube.read_cube(spark, str(tmp_path / "a.nc"), first=30, last=99).count() == 35


@pytest.mark.parametrize("new", [False, True])
def test_chunks_that_were_never_written_and_other_orders(tmp_path, new):
    values = values_of((6, 5, 7))
    data = hdf5_cube(values, new, range(5), range(7), chunk=(2, 5, 7), skip=(1,))
    (tmp_path / "a.nc").write_bytes(data)
    with cube.opened(str(tmp_path / "a.nc")) as f:
        h = hdf5.File(f)
        got = h.steps("temp", 1, 6)
        assert np.isnan(got[1:3]).all() and np.array_equal(got[[0, 3, 4]], values[[1, 4, 5]], equal_nan=True) and h.run() == 2
    turned = hdf5_cube(values.transpose(2, 0, 1), new, range(5), range(7), dims=("lon", "time", "lat"), chunk=(3, 2, 2), filters=(hdf5.SHUFFLE,))
    (tmp_path / "b.nc").write_bytes(turned)
    with cube.opened(str(tmp_path / "b.nc")) as f:
        assert np.array_equal(hdf5.File(f).steps("temp", 2, 5), values[2:5], equal_nan=True)


def test_only_the_chunks_asked_for_are_read(tmp_path):
    values = values_of((60, 5, 7))
    for new in (False, True):
        data, reads = hdf5_cube(values, new, range(5), range(7), chunk=(2, 5, 7)), []

        class Seen:
            def read_at(self, n, at):
                reads.append((at, n))
                return data[at : at + n]

        h = hdf5.File(Seen())
        reads.clear()
        h.steps("temp", 20, 22)
        assert sum(n == 2 * 5 * 7 * 4 for _, n in reads) == 1


def test_what_is_not_read_says_so():
    class Bytes:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    with pytest.raises(ValueError):
        hdf5.File(Bytes(b"CDF\1" + bytes(200)))
    data = bytearray(hdf5_cube(values_of((6, 5, 7)), True, range(5), range(7), chunk=(2, 5, 7)))
    at = data.rindex(struct.pack("<IIII", 2, 5, 7, 4)) + 16
    data[at] = 4
    with pytest.raises(ValueError, match="chunk index 4"):
        hdf5.File(Bytes(bytes(data))).steps("temp", 0, 1)
    with pytest.raises(ValueError, match="too early"):
        hdf5.File(Bytes(bytes(data[:-20])))
