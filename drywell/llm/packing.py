"""Best-fit packing with large-item matching.

Items above a third of the capacity fit at most twice in a bin, so they are matched greedily: the
largest with the largest partner that still fits. Smaller items, from large to small, fill the
smallest gap that takes them. Items of one length are alike, so the plan is made on the counts of
each length (at most `capacity` numbers on the driver, however many documents there are) and says
how many bins of each pattern there are. Items then find their place by their rank among those of
their length; ranks come from counts by (length, salt), so a common length is no hot group.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import blocks, encoder, tokenizer_path

CAPACITY, END = 2048, 0
#: A common length is dealt to one window for so many pieces, to LEAST_SALTS at least.
PIECES_A_SALT, LEAST_SALTS = 100_000, 256
PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of bins, [(length, repeats), ...]) that hold all items of the counts by length."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    large = sorted(s for s in left if 3 * s > capacity)
    groups: list[tuple[int, int, list[tuple[int, int]]]] = []  # gap, bins, content
    while large:
        s = large[-1]
        at = bisect_left(large, capacity - s + 1) - 1
        if at < 0:
            groups.append((capacity - s, left[s], [(s, 1)]))
            large.pop()
            continue
        t = large[at]
        n = left[s] // 2 if s == t else min(left[s], left[t])
        if n:
            groups.append((capacity - s - t, n, [(s, 2)] if s == t else [(s, 1), (t, 1)]))
            left[s] -= n
            left[t] -= n
        if s == t and left[s] == 1:  # the odd one looks for a smaller partner
            left[s] = 0
            large.pop()
            if large:
                left[large[-1]] -= 1
                groups.append((capacity - s - large[-1], 1, [(s, 1), (large[-1], 1)]))
            else:
                groups.append((capacity - s, 1, [(s, 1)]))
        large = [x for x in large if left[x] > 0]
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    order: list[int] = []

    def put(gap, n, content):
        if n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((n, content))

    for gap, n, content in groups:
        put(gap, n, content)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(order, s)
            if at == len(order):
                put(capacity, -(-n // (capacity // s)), [])
                continue
            gap = order[at]
            bins, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            k = gap // s
            full = min(bins, n // k)
            put(gap - k * s, full, [*content, (s, k)])
            n -= full * k
            if full < bins and n:
                put(gap - n * s, 1, [*content, (s, n)])
                full, n = full + 1, 0
            put(gap, bins - full, content)
    return [(n, content) for gap in order for n, content in gaps[gap] if content]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, number of ranks, first sequence, repeats in a sequence, offset of the first): where each rank goes."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, content in patterns:
        at = 0
        for s, k in content:
            out.append((s, used.get(s, 0), n * k, sequence, k, at))
            used[s] = used.get(s, 0) + n * k
            at += s * k
        sequence += n
    return out


def pieces_of(docs: DataFrame, path: str, capacity: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """Every document's ids with the end id, cut at `capacity`; no shuffle. row_id tells rows of one doc_id apart."""

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for start, length in blocks(batch.column(2)):
                rows, ids = batch.column(0).slice(start, length).to_pylist(), batch.column(1).slice(start, length).to_pylist()
                flat, ends = enc.encode(batch.column(2).slice(start, length))
                out, at = [], 0
                for row, doc, stop in zip(rows, ids, ends.tolist()):
                    own = np.append(flat[at:stop], flat.dtype.type(end)).astype("<u4")
                    at = stop
                    for k, a in enumerate(range(0, len(own), capacity)):
                        cut = own[a : a + capacity]
                        out.append((row, doc, k, a, len(cut), zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.monotonically_increasing_id().alias("row_id"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset. items: a `length` in 1..capacity and a unique (row_id, piece), in a stored table.

    Repeated and tied items take different places. An empty table stays empty.
    """
    salts = max(LEAST_SALTS, items.count() // PIECES_A_SALT)
    salt = F.pmod(F.xxhash64("row_id", "piece"), F.lit(salts)).cast("int")
    by_salt = items.groupBy("length", salt.alias("salt")).agg(F.count("*").alias("n"))
    by_salt = common.written(by_salt, "lengths")  # at most capacity x salts rows
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, capacity))
    spark = items.sparkSession
    before = by_salt.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = (
        items.withColumn("salt", salt)
        .withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("row_id", "piece")) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("rank") + F.col("before"))
    )
    lengths = np.array([x[0] for x in table], np.int64)
    order = np.lexsort(([x[1] for x in table], lengths)) if table else np.zeros(0, np.int64)
    sent = spark.sparkContext.broadcast(np.array(table, np.int64).reshape(-1, 6)[order])  # a few rows for each length at most
    names = [x for x in items.columns if x not in ("sequence_id", "offset")]

    def run(batches):
        where = sent.value
        # One ascending key for lengths and ranks: a rank counts on from all places of shorter lengths.
        sizes = np.zeros(capacity + 1, np.int64)
        np.add.at(sizes, where[:, 0], where[:, 2])
        shorter = np.cumsum(sizes) - sizes
        keys = shorter[where[:, 0]] + where[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(x)).astype(np.int64) for x in ("length", "rank"))
            row = where[np.searchsorted(keys, shorter[length] + rank, "right") - 1]
            k = rank - row[:, 1]
            out = [batch.column(x) for x in names] + [pa.array(row[:, 3] + k // row[:, 4]), pa.array(row[:, 5] + k % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*names).schema) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece with the end id; a null id stays null; rows that repeat
    a doc_id are packed as documents of their own; other columns are not read. Pieces are stored in
    the shared folder before they are counted, so counts and places come from the same rows.
    """
    common.prepare(docs.sparkSession)
    items = common.written(pieces_of(docs, path, capacity, end, id_col, text_col), "pieces")
    return pack(items, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), tokenizer_path())
