"""WARC records in ZIP packages, read by range.

A package holds an archive member of records, each a gzip member of its own, and an index member
with a line per record (offset and length in the archive). Members are stored, so a record is a
range of the package. The reader finds the central directory from the file's end, by the ZIP64
directory where sizes ask for it, then the members, and fetches records by range only.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 100
#: A package is closed once its archive has so many bytes; a task holds one archive at a time.
PACKAGE_BYTES = 32 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
U32, U16 = 0xFFFFFFFF, 0xFFFF


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload of its own."""
    clean = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {clean} {digest}')}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] + [f"WARC-Refers-To-Page-ID: {refers_to}"] * (refers_to is not None)
        block += b"\r\n"
    else:
        block += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one WARC record with an HTTP block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> list[bytes]:
    """Parts of a ZIP file with stored members. zip64: directory with 64-bit fields even where 32 bits do."""
    out, central, at = [], [], 0
    for name, data in members:
        raw, crc, n = name.encode(), zlib.crc32(data), len(data)
        wide = zip64 or n >= U32 or at >= U32
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x5821, crc, U32 if wide else n, U32 if wide else n, len(raw), len(extra)) + raw + extra
        more = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 0x5821, crc, U32 if wide else n, U32 if wide else n, len(raw), len(more), 0, 0, 0, 0, U32 if wide else at) + raw + more)
        out += [local, data]
        at += len(local) + n
    directory = b"".join(central)
    wide = zip64 or at >= U32 or len(members) >= U16
    end = b""
    if wide:
        end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(directory), at)
        end += struct.pack("<IIQI", 0x07064B50, 0, at + len(directory), 1)
    end += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, U16 if wide else len(members), U16 if wide else len(members), U32 if wide else len(directory), U32 if wide else at, 0)
    return [*out, directory, end]


class ZipReader:
    """Members of a ZIP file that offers read_at(length, offset) and size."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65_557)
        tail = read_at(size - tail_at, tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        place = tail_at + at - 20
        if place >= 0 and (locator := read_at(20, place))[:4] == b"PK\x06\x07":
            wide = read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 directory where its locator points")
            count, length, start = struct.unpack_from("<QQQ", wide, 32)
        self.members: dict[str, tuple[int, int, int]] = {}  # method, size, place of the local header
        directory, at = read_at(length, start), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", directory, at + 10)
            packed, full, n, m, k = struct.unpack_from("<IIHHH", directory, at + 20)
            header, = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n].decode()
            extra, p = directory[at + 46 + n : at + 46 + n + m], 0
            while p + 4 <= len(extra):
                tag, size_ = struct.unpack_from("<HH", extra, p)
                if tag == 1:
                    q = p + 4
                    if full == U32:
                        full, = struct.unpack_from("<Q", extra, q)
                        q += 8
                    if packed == U32:
                        packed, = struct.unpack_from("<Q", extra, q)
                        q += 8
                    if header == U32:
                        header, = struct.unpack_from("<Q", extra, q)
                p += 4 + size_
            self.members[name] = (method, packed, header)
            at += 46 + n + m + k

    def locate(self, name: str) -> tuple[int, int]:
        """(start, length) of a stored member's bytes in the file."""
        method, size, header = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored")
        local = self.read_at(30, header)
        n, m = struct.unpack_from("<HH", local, 26)
        return header + 30 + n + m, size


def decisions(pages: DataFrame) -> DataFrame:
    """(digest, least, ties) of payloads of LEAST_BYTES or more that several rows have: the response's page_id (null last) and how many rows have it."""
    by_page = pages.where(F.col("n") >= LEAST_BYTES).groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    found = by_page.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "rows")).alias("least"), F.sum("rows").alias("rows"))
    return found.where("rows > 1").select("digest", F.struct("least.page_id").alias("least"), F.col("least.rows").alias("ties"))


def with_decisions(rows: DataFrame) -> DataFrame:
    """rows (page_id, url, html, digest, n) with `again` and `first`, for revisits the response's page_id.

    What a row becomes follows from its page_id and digest alone, so nothing depends on its place in
    a read. Only where several rows share the smallest page_id of a digest are these rows stored with
    a number of their own, and that with the smallest number is the response.
    """
    # Only digests that repeat are joined; Spark broadcasts them if they are few, else deals both sides by digest.
    chosen = common.written(decisions(rows.drop("url", "html")), "repeats")
    joined = rows.join(chosen, "digest", "left")
    own = F.col("least").isNotNull() & F.col("page_id").eqNullSafe(F.col("least.page_id"))
    tied = own & (F.col("ties") > 1)
    names = ["page_id", "url", "html", "digest"]
    out = joined.where(~F.coalesce(tied, F.lit(False))).select(*names, (F.col("least").isNotNull() & ~own).alias("again"), F.col("least.page_id").alias("first"))
    if chosen.where("ties > 1").isEmpty():
        return out
    alike = common.written(joined.where(tied).select(*names, F.monotonically_increasing_id().alias("row")), "alike")
    heads = alike.groupBy("digest").agg(F.min("row").alias("head"))
    alike = alike.join(heads, "digest").select(*names, (F.col("row") != F.col("head")).alias("again"), F.col("page_id").alias("first"))
    return out.unionByName(alike)


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zip64: bool = False) -> DataFrame:
    """Writes a record for every row into packages under folder; the stored manifest (path, records).

    Null payloads are empty; of rows that repeat page_id and payload one is the response and the
    others revisit it; null ids come last. An empty table gives an empty manifest; other columns,
    whatever their names, are not read. Names are new in each attempt, and the manifest has those of
    ended attempts only.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).withColumn("n", F.octet_length("html"))
    rows = with_decisions(rows)

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        files, base = common.open_fs(folder)
        files.create_dir(base, recursive=True)
        data, index, size = [], [], 0

        def flush():
            name = f"part-{part:05d}-{number:05d}-{uuid.uuid4().hex}.wacz"
            with files.open_output_stream(f"{base}/{name}") as out:
                for x in zip_bytes([(ARCHIVE, b"".join(data)), (INDEX, "".join(index).encode())], zip64):
                    out.write(x)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page, url, html, digest, again, first in zip(*(batch.column(k).to_pylist() for k in range(6))):
                kind = "revisit" if again else "response"
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = deflate.compress(record(kind, page, url, digest, html.encode("utf-8", "surrogatepass"), first if again else None)) + deflate.flush()
                index.append(json.dumps({"offset": size, "length": len(packed), "page": page}) + "\n")
                data.append(packed)
                size += len(packed)
                if size >= PACKAGE_BYTES:
                    yield flush()
                    data, index, size, number = [], [], 0, number + 1
        if index:
            yield flush()

    return common.written(rows.mapInArrow(run, "path string, records long"), "packages")


def read_records(source, size: int, most: int = 4 << 20):
    """(headers, payload) of a package's records in the order of its index, by reads of at most `most` bytes or one record."""
    reader = ZipReader(lambda n, at: source.read_at(n, at), size)
    start, _ = reader.locate(ARCHIVE)
    at, n = reader.locate(INDEX)
    ranges = [(x["offset"], x["length"]) for x in map(json.loads, source.read_at(n, at).splitlines())]
    i = 0
    while i < len(ranges):
        j = i + 1
        while j < len(ranges) and ranges[j][0] == sum(ranges[j - 1]) and sum(ranges[j]) - ranges[i][0] <= most:
            j += 1
        block = source.read_at(sum(ranges[j - 1]) - ranges[i][0], start + ranges[i][0])
        for offset, length in ranges[i:j]:
            yield parse_record(zlib.decompress(block[offset - ranges[i][0] : offset - ranges[i][0] + length], 31))
        i = j


def read_packages(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the packages.

    A response's size and digest are those of the payload read; a revisit has its digest from its
    header and its size from the response with that digest. A revisit whose response is in none of
    the packages raises an error.
    """
    spark = manifest.sparkSession
    common.prepare(spark)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = common.open_fs(path)
                out = []
                with files.open_input_file(name) as source:
                    for head, payload in read_records(source, source.size()):
                        again = head["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:") if again else hashlib.sha256(payload).hexdigest()
                        page, first = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                        out.append((None if page is None else int(page), None if again else len(payload), digest, head["WARC-Type"], None if first is None else int(first)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = common.written(manifest.select("path").repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")
    own = found.where("record_type = 'response'")
    again = found.where("record_type = 'revisit'").drop("payload_bytes")
    wanted = again.select("payload_digest").distinct()
    sizes = own.join(wanted, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    missing = F.raise_error(F.concat(F.lit("no response for the revisit of "), F.col("payload_digest"))).cast("long")
    again = again.join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.coalesce("payload_bytes", missing))
    return own.unionByName(again.select(*own.columns))


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(common.table(spark, sf_dir, "pages"), common.fresh(spark, "warc")))
