"""Token ids in files by Re-Pair grammar compression.

Documents go in ascending id order into shards. A shard's sequence is rewritten in rounds: pairs of
neighbours that occur more than once become nonterminals, the more frequent before the less where
they overlap, with rules that name their two parts, until no pair occurs twice. Pairs never reach
across the end of a document. Rules are stored with the number of ids they expand to, so any range of
a document's ids can be decoded without the rest.

A shard file, little-endian: magic, then (first nonterminal, end id, rules, documents, symbols, ids,
bits of a symbol, bits of a length) as 64-bit integers, then arrays: left and right parts of the
rules and their expansion lengths (in as many bits as needed, high bits first), document ids (64),
null flags (8), where each document's symbols start (64), the symbols (packed like the parts), and a
CRC-32 of all before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import blocks, encoder, tokenizer_path

MAGIC, END = b"DWRP0002", 1
#: Without another number given, ids from here on are free for nonterminals (the vocabulary has 49,408 entries).
FIRST = 49_408
SHARD_IDS = 1 << 20
HEADER = struct.Struct("<8q")


def compress(ids: np.ndarray, end: int = END, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, left, right, lengths): symbols from `first` on are rules of two parts that expand to so many ids; no pair occurs twice.

    Rounds after the first look only at places whose pair occurred more than once in the round before
    or holds a new symbol: no other pair can come to occur twice.
    """
    seq = ids.astype(np.uint32)
    left, right, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], np.ones(first, np.int64)
    at = np.arange(max(0, len(seq) - 1))
    while len(at):
        a, b = seq[at], seq[at + 1]
        ends = (a == end) | (b == end)
        at, a, b = at[~ends], a[~ends], b[~ends]
        key = a.astype(np.uint64) << np.uint64(32) | b
        beside = np.zeros(len(at), bool)
        beside[1:] = at[1:] == at[:-1] + 1
        # Pairs that overlap themselves count once: every second place of a run of equal keys is left out.
        start = np.ones(len(at), bool)
        start[1:] = ~beside[1:] | (key[1:] != key[:-1])
        place = np.arange(len(at))
        open_ = (place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0
        ordered = np.sort(key[open_])
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(ordered)))
        often = np.flatnonzero(count > 1)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")]
        pairs = ordered[begin[often]]
        # A table by hash finds a place's pair; of pairs with one slot the more frequent is replaced in this round.
        bits = max(12, int(len(pairs)).bit_length() + 2)
        slot = lambda k: (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)  # noqa: E731, B023
        held, taken = np.full(1 << bits, len(pairs), np.int32), np.zeros(1 << bits, bool)
        slots = slot(pairs)
        held[slots[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        taken[slots] = True
        own = slot(key)
        repeats = taken[own]  # with a few others that share a slot
        rank = held[own]
        rank[~open_ | (pairs[np.minimum(rank, len(pairs) - 1)] != key)] = len(pairs)
        take = rank < len(pairs)
        take[1:] &= ~beside[1:] | (rank[1:] < rank[:-1])
        take[:-1] &= ~beside[1:] | (rank[:-1] <= rank[1:])
        # The most frequent pair of all always takes all its places, so every round makes rules.
        used = np.bincount(rank[take], minlength=len(pairs)) > 1
        take[take] = used[rank[take]]
        number = (np.cumsum(used) - 1 + len(lengths)).astype(np.uint32)
        left.append((pairs[used] >> np.uint64(32)).astype(np.uint32))
        right.append(pairs[used].astype(np.uint32))
        lengths = np.concatenate([lengths, lengths[left[-1]] + lengths[right[-1]]])
        where = at[take]
        seq[where] = number[rank[take]]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        look = np.zeros(len(seq), bool)
        look[at[repeats]] = True
        look[where] = True
        # The symbol before a new one is the last that stays before it.
        look[np.where(keep[np.maximum(where - 1, 0)], where - 1, where - 2)[where > 0]] = True
        at = np.flatnonzero(look[keep])
        seq = seq[keep]
        at = at[at < len(seq) - 1]
    return seq, np.concatenate(left), np.concatenate(right), lengths[first:]


def expanded(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of symbols in order, where each symbol's begin): every level of rules at once puts its parts in their places."""
    size = np.concatenate([np.ones(first, np.int64), lengths.astype(np.int64)])
    stop = np.cumsum(size[symbols])
    begin = stop - size[symbols]
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint32)
    todo, at = symbols, begin
    while len(todo):
        plain = todo < first
        out[at[plain]] = todo[plain]
        rule, at = todo[~plain] - np.uint32(first), at[~plain]
        todo = np.concatenate([left[rule], right[rule]])
        at = np.concatenate([at, at + size[left[rule]]])
    return out, begin


def to_bits(values: np.ndarray, bits: int) -> bytes:
    return np.packbits(np.unpackbits(values.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]).tobytes()


def from_bits(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 32), np.uint8)
    out[:, 32 - bits :] = np.unpackbits(data, count=n * bits).reshape(n, bits)
    return np.packbits(out, axis=1).view(">u4").ravel().astype(np.uint32)


def pack_shard(doc_ids: list[int | None], lens: list[int], ids: np.ndarray, end: int = END, first: int = FIRST) -> bytes:
    """The file of one shard: documents of lens[i] ids each, the last of them the end id. All ids are below `first`."""
    if len(ids) and (int(ids.max()) >= first or end >= first):
        raise ValueError("an id is among the nonterminals")
    symbols, left, right, lengths = compress(ids, end, first)
    # No pair holds an end id, so a document starts at a symbol of its own.
    upto = np.cumsum(np.concatenate([np.ones(first, np.int64), lengths])[symbols])
    starts = np.searchsorted(upto, np.cumsum(lens) - np.asarray(lens, np.int64), "right").astype(np.int64)
    known = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    null = np.array([d is None for d in doc_ids], np.uint8)
    wide, deep = int(first + len(left)).bit_length(), int(max(lengths, default=0)).bit_length() or 1
    body = b"".join([
        MAGIC, HEADER.pack(first, end, len(left), len(doc_ids), len(symbols), len(ids), wide, deep), to_bits(left, wide), to_bits(right, wide), to_bits(lengths, deep),
        known.astype("<i8").tobytes(), null.tobytes(), starts.astype("<i8").tobytes(), to_bits(symbols, wide),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard read back; ids(i) decodes a document and ids(i, a, b) a range of it."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("not a whole shard file")
        self.first, self.end, rules, self.docs, symbols, self.total, wide, deep = HEADER.unpack_from(data, 8)
        at = 8 + HEADER.size

        def take(n, kind):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        def packed(n, bits):
            return from_bits(take(-(-n * bits // 8), np.uint8), n, bits)

        self.left, self.right, self.lengths = packed(rules, wide), packed(rules, wide), packed(rules, deep)
        self.doc_ids, self.null, self.starts, self.symbols = take(self.docs, "<i8"), take(self.docs, "u1"), take(self.docs, "<i8"), packed(symbols, wide)

    def everything(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, where each document ends)."""
        out, begin = expanded(self.symbols, self.left, self.right, self.lengths, self.first)
        return out, np.append(begin[self.starts[1:]], self.total)[: self.docs]

    def length(self, symbol: int) -> int:
        return 1 if symbol < self.first else int(self.lengths[symbol - self.first])

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> list[int]:
        """Ids start..stop of a document, expanding only rules that reach into the range."""
        last = self.starts[doc + 1] if doc + 1 < self.docs else len(self.symbols)
        todo = [int(s) for s in self.symbols[self.starts[doc] : last]][::-1]
        out: list[int] = []
        at = 0
        while todo and (stop is None or at < stop):
            s = todo.pop()
            n = self.length(s)
            if at + n <= start:
                at += n
            elif s >= self.first:
                todo += [int(self.right[s - self.first]), int(self.left[s - self.first])]
            else:
                out.append(s)
                at += 1
        return out


def write_shards(docs: DataFrame, folder: str, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes and stores all rows; the manifest (part, shard, path, docs, ids, bytes), itself stored.

    Rows go in ascending id order, null ids first, rows of one id by the hash of their text, then text. Files get a name of their
    own in each attempt; only those of attempts that ended are in the manifest. Null texts are empty;
    an empty table gives an empty manifest; other columns, whatever their names, are not read. Rows
    without an id, or rows of one id, may be dealt over many tasks by that hash. `path` may be any tokenizer file whose ids end below 2**31.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("h", F.xxhash64("text"))

    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        files, base = common.open_fs(folder)
        files.create_dir(base, recursive=True)
        ids, lens, flat, shard, size = [], [], [], 0, 0

        def flush():
            name = f"part-{part:05d}-{shard:05d}-{uuid.uuid4().hex}.repair"
            data = pack_shard(ids, lens, np.concatenate(flat), end, enc.size)
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            row = [part, shard, f"{folder}/{name}", len(ids), sum(lens), len(data)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "shard", "path", "docs", "ids", "bytes"])

        for batch in batches:
            for start, length in blocks(batch.column(1)):
                own, ends = enc.encode(batch.column(1).slice(start, length))
                at = 0
                for doc, stop in zip(batch.column(0).slice(start, length).to_pylist(), ends.tolist()):
                    flat += [own[at:stop], np.array([end], own.dtype)]
                    ids.append(doc)
                    lens.append(stop - at + 1)
                    size, at = size + stop - at + 1, stop
                    if size >= shard_ids:
                        yield flush()
                        ids, lens, flat, shard, size = [], [], [], shard + 1, 0
        if ids:
            yield flush()

    sorted_ = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return common.written(sorted_.mapInArrow(run, "part int, shard int, path string, docs long, ids long, bytes long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all documents before."""
    spark = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))  # a row for each partition of the write
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("ids").over(W.partitionBy("part").orderBy("shard")) - F.col("ids")
    files = manifest.withColumn("within", within).join(before, "part").select("path", (F.col("before") + F.col("within")).alias("base"))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, name = common.open_fs(path)
                with files.open_input_file(name) as source:
                    shard = Shard(source.read())
                ids, ends = shard.everything()
                starts = np.append(0, ends[:-1])
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                known = pa.array(shard.doc_ids, mask=shard.null.astype(bool))
                yield pa.RecordBatch.from_arrays([known, pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return read_shards(write_shards(docs, common.fresh(spark, "repair"), tokenizer_path()))
