"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints differ in at most 2 of 64 bits only if they agree in one of three blocks of bits, so
each distinct fingerprint goes to three groups, by block and value. A task turns its groups' blocks
to the front, sorts by Gray rank, which keeps a block's values together and its likes near, and
builds nodes over runs of the order: a node holds the bits that all its members share and the upper
node does not hold yet. A search goes down with the differences so far and leaves a node out, with
all its members, once they exceed the limit. Links are merged in the task, and only each member's
link to the smallest fingerprint of its part goes on to the search for components.

Near copies by similarity (`near_copies`) use the same index at a wider limit: fingerprints of four
words of 64 bits find the candidates, and each is confirmed by the Jaccard similarity of the texts'
five-word shingles. That joins most copies into parts; an exact join on the rarest shingles then
finds every link between different parts that is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import blocks

SHINGLE, SEED, LIMIT = 3, 42, 2
FANOUT, QUERIES, PAIRS = 8, 4096, 1_000_000
U = np.uint64
#: Near copies: words to a shingle and the similarity from which texts are copies.
NEAR_WORDS, NEAR = 5, 0.8
#: Their candidates: 64-bit words of a fingerprint, of each word five blocks, and the bits that one word and all of them may differ in.
PRINT_WORDS, PRINT_CUTS, WORD_LIMIT, PRINT_LIMIT = 4, 4, 13, 50
#: Searches of near copies, each by fingerprints of its own.
TURNS = 3
#: Bits of the buckets that shingles are counted in; the counts order shingles, rare first, and no result depends on them.
BUCKET_BITS = 18
#: Rare shingles that linked texts must share, if their sets are that large: pairs that share fewer are not confirmed.
SHARED = 3
#: Bits, as a power of two, that a filter of rows (`membership`) has at most, and for each row it is to tell.
FILTER_BITS, BITS_A_ROW = 26, 16
#: An odd factor whose odd multiples make further hashes of one (fixed value of a common mixer).
FACTOR = 0x9E3779B97F4A7C15


def bit_blocks(limit: int) -> tuple[tuple[int, int], ...]:
    """Blocks of bits (place from the top, width): one more than the differing bits allowed, so one of them agrees."""
    if not 0 <= limit < 64:
        raise ValueError("limit must be 0 to 63")
    ends = [64 * k // (limit + 1) for k in range(limit + 2)]
    return tuple((a, b - a) for a, b in zip(ends, ends[1:]))


BLOCKS = bit_blocks(LIMIT)


def shingle_hashes(text: str | None, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of n words, repeats included; of all words if there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U)
    joined, take = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([take(joined, seed)], U)
    at, starts = 0, []
    for w in words:
        starts.append(at)
        at += len(w) + 1
    stops = [*(s - 1 for s in starts[n:]), len(joined)]
    return np.array([take(joined[a:b], seed) for a, b in zip(starts, stops)], U)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    n, counts = len(hashes), np.zeros(64, np.int64)
    for a in range(0, n, 65536):
        counts += np.unpackbits(hashes[a : a + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): signed form of the 64 bits. Null texts have no words: fingerprint zero. No shuffle."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for start, length in blocks(batch.column(1)):
                fps = [simhash(shingle_hashes(t)) for t in batch.column(1).slice(start, length).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), pa.array(np.array(fps, U).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, "doc_id long, fp long")


def rotated(fp: np.ndarray, shift: int) -> np.ndarray:
    """The bits from place `shift` on at the front."""
    return fp if not shift else (fp << U(shift)) | (fp >> U(64 - shift))


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of a code in the Gray order: each bit is the parity of the bits down to it."""
    rank = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(s)
    return rank


class Node:
    """One level: pattern and mask of what a node adds to its upper node, and its first and last child."""

    __slots__ = ("first", "last", "mask", "pattern")

    def __init__(self, first, last, mask, pattern):
        self.first, self.last, self.mask, self.pattern = first, last, mask, pattern


class GrayIndex:
    """Codes in Gray order (distinct), groups given by their first `lead` bits; search(i..j) yields links within `limit`."""

    def __init__(self, codes: np.ndarray, lead: int, limit: int = LIMIT):
        self.codes, self.limit = codes, limit
        lead_of = codes >> U(64 - lead)
        top = np.flatnonzero(np.concatenate([[True], lead_of[1:] != lead_of[:-1]]))
        self.group = np.repeat(np.arange(len(top)), np.diff(np.append(top, len(codes))))
        # Levels from the leaves up; runs of FANOUT within a group, until a group is one node.
        full = np.full(len(codes), ~U(0))
        mask, value, group = full, codes, self.group
        self.levels: list[Node] = []
        while len(value) > len(top):
            start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            place = np.arange(len(value)) - np.repeat(start, np.diff(np.append(start, len(value))))
            first = np.flatnonzero(place % FANOUT == 0)
            last = np.append(first[1:], len(value))
            ones, zeros = np.bitwise_and.reduceat(mask & value, first), np.bitwise_and.reduceat(mask & ~value, first)
            up = ones | zeros
            self.levels.append(Node(first, last, mask & ~np.repeat(up, last - first), value))
            mask, value, group = up, ones, group[first]
        self.levels.append(Node(None, None, mask, value))

    def steps(self):
        """(start, stop) of queries, few enough that their pairs with whole groups stay within PAIRS."""
        n = np.bincount(self.group)[self.group]
        start = run = 0
        for k, m in enumerate(n.tolist()):
            if run and (run + m > PAIRS or k - start >= QUERIES):
                yield start, k
                start, run = k, 0
            run += m
        yield start, len(n)

    def links(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) of places, other > query, within the limit; queries are start..stop."""
        query = np.arange(start, stop)
        node = self.group[start:stop]
        top = self.levels[-1]
        so_far = np.bitwise_count((self.codes[query] ^ top.pattern[node]) & top.mask[node]).astype(np.int8)
        for k in range(len(self.levels) - 2, -1, -1):
            level = self.levels[k]
            keep = so_far <= self.limit
            query, node, so_far = query[keep], node[keep], so_far[keep]
            n = level.last[node] - level.first[node]
            child = np.repeat(level.first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            query, so_far = np.repeat(query, n), np.repeat(so_far, n)
            so_far = so_far + np.bitwise_count((self.codes[query] ^ level.pattern[child]) & level.mask[child]).astype(np.int8)
            node = child
        keep = (so_far <= self.limit) & (node > query)
        return query[keep], node[keep]


def merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after links a-b: each place gets the smallest place of its part."""
    while len(a):
        parent = parent[parent]
        x, y = parent[a], parent[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def local_links(fps: np.ndarray, shift: int, lead: int, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """For distinct fingerprints, (member, smallest linked member) of each part with links inside a group of equal lead bits."""
    group = rotated(fps, shift) >> U(64 - lead)
    _, of, n = np.unique(group, return_inverse=True, return_counts=True)
    fps = fps[n[of] > 1]  # groups of one have no links
    if not len(fps):
        return fps, fps
    codes = rotated(fps, shift)
    order = np.argsort(gray_rank(codes))
    fps = fps[order]
    index, parent = GrayIndex(codes[order], lead, limit), np.arange(len(fps))
    for a, b in index.steps():
        parent = merged(parent, *index.links(a, b))
    own = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[own], fps[parent[own]]


def dealt_groups(batches, columns: int, held: int = 1 << 20):
    """Arrow batches sorted by (block, value), the last two columns, as arrays (block, the first `columns`) of whole groups, about `held` rows at a time."""
    kept: list[list[np.ndarray]] = []

    def out(parts):
        joined = [np.concatenate(x) for x in zip(*parts)]
        for block in np.unique(joined[-2]).tolist():
            own = joined[-2] == block
            yield block, [x[own] for x in joined[:columns]]

    for batch in batches:
        arrays = [np.asarray(batch.column(k)) for k in range(batch.num_columns)]
        while len(arrays[0]) and sum(len(x[0]) for x in kept) + len(arrays[0]) > held and kept:
            # What is held ends where the last group of it ends, which may be in this batch.
            last = (kept[-1][-2][-1], kept[-1][-1][-1])
            same = (arrays[-2] == last[0]) & (arrays[-1] == last[1])
            cut = int(same.sum())  # sorted, so these come first
            if cut == len(same):
                break
            yield from out([*kept, [x[:cut] for x in arrays]])
            kept, arrays = [], [x[cut:] for x in arrays]
        if len(arrays[0]):
            kept.append(arrays)
    if kept:
        yield from out(kept)


def link_fingerprints(distinct: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b) links that join the distinct fingerprints `fp` into the components of all links within the limit.

    Tasks get their groups sorted by (block, value) and hold about a million fingerprints at a time,
    or one group.
    """
    spark, cuts = distinct.sparkSession, bit_blocks(limit)
    fp = F.col("fp")
    dealt = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.shiftleft(fp, shift), 64 - width).alias("value")) for k, (shift, width) in enumerate(cuts)))).alias("g"))
    dealt = dealt.select("fp", "g.block", "g.value")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        for block, (fps,) in dealt_groups(batches, 1):
            a, b = local_links(fps.view(U), *cuts[block], limit)
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000].view(np.int64)), pa.array(b[i : i + 100_000].view(np.int64))], names=["a", "b"])

    return dealt.repartition(parts, "block", "value").sortWithinPartitions("block", "value").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable by links.

    Copies share a fingerprint and are one node of the search. Texts without words (null and empty
    too) have fingerprint zero and link like any other. A null doc_id is kept as null and never
    chosen as component_id unless its component has no other. Repeated rows each give a row.
    """
    spark = docs.sparkSession
    rows = common.written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = common.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = common.connected_components(link_fingerprints(nodes.select("fp")), "links")
    roots = common.written(roots, "roots")  # only fingerprints with links
    least = (
        roots.join(nodes, roots["node"] == nodes["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
        .join(roots, "root").select(F.col("node").alias("fp"), "component_id")
    )
    of = common.written(nodes.join(least, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def long_print(hashes: np.ndarray, turn: int = 0) -> list[int]:
    """PRINT_WORDS SimHashes of the same shingles, each by another hash of theirs; each turn takes other hashes."""
    out = []
    for k in range(turn * PRINT_WORDS, (turn + 1) * PRINT_WORDS):
        x = (hashes ^ (hashes >> U(32))) * U((FACTOR * (2 * k + 1)) % 2**64)
        out.append(simhash(x ^ (x >> U(29))))
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Numbers of the links a-b that make a spanning forest of least differences d over n places."""
    live = np.argsort(d, kind="stable")
    parent, kept = np.arange(n), [np.zeros(0, np.int64)]
    while len(live):
        x, y = parent[a[live]], parent[b[live]]
        live, x, y = live[x != y], x[x != y], y[x != y]
        least = np.full(n, len(live))  # of each part, the place of its first link in the order
        for end in (x, y):
            np.minimum.at(least, end, np.arange(len(live)))
        pick = live[np.unique(least[least < len(live)])]
        kept.append(pick)
        parent = merged(parent, a[pick], b[pick])
    return np.concatenate(kept)


def local_candidates(part: np.ndarray, words: np.ndarray, word: int, shift: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, differing bits) of places in groups of equal lead bits of a word: a spanning forest of those within both limits and of different parts."""
    order = np.argsort(gray_rank(rotated(words[word], shift)))
    index = GrayIndex(rotated(words[word], shift)[order], lead, WORD_LIMIT)
    held, n = [np.zeros(0, np.int64)] * 3, len(order)
    for start, stop in index.steps():
        a, b = (order[x] for x in index.links(start, stop))
        a, b = a[part[a] != part[b]], b[part[a] != part[b]]
        d = np.bitwise_count(words[:, a] ^ words[:, b]).sum(0, dtype=np.int64)
        near = d <= PRINT_LIMIT
        held = [np.concatenate(x) for x in zip(held, (a[near], b[near], d[near]))]
        if len(held[0]) > PAIRS:
            own = forest(n, *held)
            held = [x[own] for x in held]
    own = forest(n, *held)
    return held[0][own], held[1][own], held[2][own]


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, d) with a < b: nodes (node, part, w0, w1, ...) of different parts whose fingerprints are near; of each group of equal bits a spanning forest."""
    spark, cuts = nodes.sparkSession, bit_blocks(PRINT_CUTS)
    words = [f"w{k}" for k in range(PRINT_WORDS)]
    groups = [
        F.struct(F.lit(w * len(cuts) + k).alias("block"), F.shiftrightunsigned(F.shiftleft(F.col(words[w]), shift), 64 - width).alias("value"))
        for w in range(PRINT_WORDS) for k, (shift, width) in enumerate(cuts)
    ]
    dealt = nodes.select("node", "part", *words, F.explode(F.array(*groups)).alias("g")).select("node", "part", *words, "g.block", "g.value")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches):
        for block, (node, part, *prints) in dealt_groups(batches, 2 + PRINT_WORDS, 1 << 18):
            a, b, d = local_candidates(part, np.array(prints).view(U), block // len(cuts), *cuts[block % len(cuts)])
            for i in range(0, len(a), 100_000):
                x, y = node[a[i : i + 100_000]], node[b[i : i + 100_000]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d[i : i + 100_000])], names=["a", "b", "d"])

    return dealt.repartition(parts, "block", "value").sortWithinPartitions("block", "value").mapInArrow(run, "a long, b long, d long").distinct()


def membership(hashes: DataFrame):
    """A function of a column of longs, evenly spread: whether a value may be among the one column of hashes, true for all that are.

    It is a table of bits, of bounded size whatever the rows; where it gets crowded, more values pass that are not among them.
    """
    width = min(FILTER_BITS, max(10, (BITS_A_ROW * hashes.count()).bit_length()))
    slots = hashes.select(F.shiftrightunsigned(hashes[0], 64 - width).alias("slot"))
    found = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (width - 6), np.int64)
    table[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))

    @F.pandas_udf("boolean")
    def may(value: pd.Series) -> pd.Series:
        slot = value.to_numpy(np.int64).view(U) >> U(64 - width)
        return pd.Series((table.view(U)[slot >> U(6)] >> (slot & U(63))) & U(1) == 1)

    return may


def texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text), one row per node of wanted (node, key, least), stored, from rows (id, key, text). Of the rows only those that may be a node's least are moved."""
    may = membership(wanted.select(F.xxhash64("key", "least")))
    texts = rows.where(may(F.xxhash64("key", "id"))).select("key", "text").dropDuplicates(["key"])
    return common.written(texts.join(wanted.select("key", "node"), "key").select("node", "text"), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, alike) of each pair of nodes, stored: whether the sets of their texts' shingles have Jaccard similarity NEAR or more. Texts are moved, which take less room than their sets."""
    pairs = common.written(pairs.select("a", "b"), "pairs")
    x, y = (texts.select(F.col("node").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))

    def run(batches):
        last = {}  # by side, the node before and its set: rows come sorted by one of the two

        def own(side, node, text):
            if last.get(side, (None,))[0] != node:
                last[side] = node, np.unique(shingle_hashes(text, NEAR_WORDS))
            return last[side][1]

        for batch in batches:
            for start, length in blocks(batch.column(3)):
                a, b, s, t = (batch.column(k).slice(start, length) for k in range(4))
                alike = []
                for i, j, v, w in zip(a.to_pylist(), b.to_pylist(), s, t):
                    m, n = own(0, i, v.as_py()), own(1, j, w.as_py())
                    both = len(np.intersect1d(m, n, assume_unique=True))
                    alike.append(both >= NEAR * (len(m) + len(n) - both))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    return common.written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, alike boolean"), "confirmed")


def nearest(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: the link of least difference of each node of edges (a, b, d)."""
    ends = edges.select("a", "b", "d").union(edges.select("b", "a", "d")).groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def crossing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose nodes are of different parts, with these as part_a and part_b."""
    x, y = (nodes.select(F.col("node").alias(k), F.col("part").alias(f"part_{k}")) for k in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where("part_a != part_b")


def with_parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the parts that links (a, b) join as one, the smallest of them."""
    roots = common.connected_components(crossing(links, nodes).select(F.col("part_a").alias("a"), F.col("part_b").alias("b")), "near-links")
    joined = nodes.join(roots.select(F.col("node").alias("part"), "root"), "part", "left")
    return common.written(joined.withColumn("part", F.coalesce("root", "part")).drop("root"), "near-parts")


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How often the shingles of the texts (one column) fall into each bucket, by the leading bits of their hashes: as many numbers however many texts."""

    def run(batches):
        n = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for start, length in blocks(batch.column(0)):
                sets = [np.unique(shingle_hashes(t, NEAR_WORDS)) for t in batch.column(0).slice(start, length).to_pylist()]
                n += np.bincount((np.concatenate(sets) >> U(64 - BUCKET_BITS)).astype(np.int64), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    out = np.zeros(1 << BUCKET_BITS, np.int64)
    found = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    return out


def rarest(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest of a set's shingles, in order: so many that two sets of similarity NEAR or more share SHARED, or all they have in common. Sets without shingles share 0."""
    if not len(hashes):
        return np.zeros(1, U)
    order = np.lexsort((hashes, counts[(hashes >> U(64 - BUCKET_BITS)).astype(np.int64)]))
    return hashes[order[: len(hashes) - int(np.ceil(NEAR * len(hashes) - 1e-9)) + SHARED]]


def crossing_pairs(node: np.ndarray, part: np.ndarray, size: np.ndarray, place: np.ndarray, token: np.ndarray):
    """(a, b, need) arrays, a < b, of nodes of different parts with one token, at its place in their sets of so many shingles, whose shingles from there on suffice for NEAR.

    need is the number of tokens that the two share if they are so alike. No pair within a part is looked at.
    """
    order = np.lexsort((part, token))
    node, part, size, place, token = (x[order] for x in (node, part, size, place, token))
    ends = lambda new: np.repeat(np.append(np.flatnonzero(new), len(new))[1:], np.diff(np.append(np.flatnonzero(new), len(new))))
    other = np.append(True, token[1:] != token[:-1])
    first, last = ends(other | np.append(True, part[1:] != part[:-1])), ends(other)
    rows = np.flatnonzero(last > first)
    many = (last - first)[rows]
    steps = np.unique(np.searchsorted(np.cumsum(many), np.arange(0, many.sum(), PAIRS), "left"))
    for start, stop in zip(steps, [*steps[1:], len(rows)]):
        own, n = rows[start:stop], many[start:stop]
        x = np.repeat(own, n)
        y = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        # At one of their first SHARED common shingles, what follows in both, and those before it, bound what they have in common.
        keep = (1 + NEAR) * (np.minimum(size[x] - place[x], size[y] - place[y]) + SHARED - 1) >= NEAR * (size[x] + size[y]) - 1e-6
        x, y = x[keep], y[keep]
        need = np.clip(np.ceil(NEAR * np.maximum(size[x], size[y]) - 1e-9), 1, SHARED).astype(np.int32)
        yield np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), need


def missed_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b), stored: all pairs of nodes of different parts that may have similarity NEAR, none left out, from rows (id, key, text) and nodes (node, part, key, least)."""
    counts = shingle_counts(rows.select("text"))

    def sets(batches):
        for batch in batches:
            for start, length in blocks(batch.column(2)):
                own = [np.unique(shingle_hashes(t, NEAR_WORDS)) for t in batch.column(2).slice(start, length).to_pylist()]
                rare = [rarest(x, counts).view(np.int64) for x in own]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), pa.array(np.concatenate(rare)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), batch.column(1).slice(start, length), pa.array([len(x) for x in own], pa.int32()), lists], names=["id", "key", "size", "tokens"])

    def run(batches):
        for _, (node, part, size, place, _, token) in dealt_groups(batches, 6):
            for a, b, need in crossing_pairs(node, part, size.astype(np.int64), place.astype(np.int64), token):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(need)], names=["a", "b", "need"])

    rare = rows.select("id", "key", "text").mapInArrow(sets, "id long, key binary, size int, tokens array<long>")
    own = nodes.select("node", "part", F.col("key").alias("k"), F.col("least.id").alias("own"))
    held = rare.join(own, (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("own"))).select("node", "part", "size", F.posexplode("tokens").alias("place", "value"))
    held = held.select("node", "part", "size", "place", F.lit(0).alias("block"), "value")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = held.repartition(parts, "value").sortWithinPartitions("block", "value").mapInArrow(run, "a long, b long, need int")
    return common.written(met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b"), "missed")


def near_copies(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """(key, rows, least, ties, head): for each distinct text of rows (id, key, text), `key` standing for the text, what it needs to know which rows stay.

    Of texts that links join the row with the smallest id (null last) stays, of one id that with the
    smallest key; head says whether that is one of this text's, least is this text's smallest id and
    ties how many rows have both.

    Texts are linked if the sets of their five-word shingles (lower-cased A-Z; fewer words: the whole
    sequence) have Jaccard similarity 0.8 or more; texts without words are alike. Candidates are
    texts whose four-word fingerprints agree in one of twenty blocks and differ in few bits. Tasks
    pass on a spanning forest, of least differences, of their groups' candidates, and each node's
    nearest candidate is confirmed. In further turns nodes that had candidates are searched again by
    other fingerprints, for candidates outside of the part they are in by then.

    These turns may miss links by chance; all that they leave are found at the end. Two texts so alike
    share SHARED of their rarest shingles (a fifth of each, and as many more), or all they have, in any
    one order of all shingles: texts of different parts meet at these, and every pair that meets so
    often and whose sizes and places allow the similarity is confirmed. So the parts are exactly those
    of all links, whatever the turns.

    Whole texts are moved only for nodes that some pair names.
    """
    spark = rows.sparkSession
    common.prepare(spark)
    words = [f"w{k}" for k in range(PRINT_WORDS)]

    def run(batches):
        for batch in batches:
            for start, length in blocks(batch.column(2)):
                prints = np.array([long_print(shingle_hashes(t)) for t in batch.column(2).slice(start, length).to_pylist()], U).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(start, length) for k in range(2)] + [pa.array(prints[:, k].copy()) for k in range(PRINT_WORDS)], names=["id", "key", *words])

    prints = rows.select("id", "key", "text").mapInArrow(run, "id long, key binary, " + ", ".join(f"{w} long" for w in words))
    by_id = common.written(prints.groupBy("key", "id").agg(F.count("*").alias("ties"), *(F.min(w).alias(w) for w in words)), "prints")
    nodes = by_id.groupBy("key").agg(F.sum("ties").alias("rows"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "ties")).alias("least"), *(F.min(w).alias(w) for w in words))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = nodes.withColumn("part", F.col("node"))
    edges = common.written(candidates(nodes), "candidates")
    found = nodes.select("node", "key", F.col("least.id").alias("least"))
    wanted = common.written(found.join(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "node"), "wanted")
    texts = texts_of(rows, wanted)
    told = None  # all pairs looked at, so that none is twice
    for turn in range(turns):
        common.tidy(spark)
        if turn:
            live = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
            near = nodes.select("node", "part").join(live, "node", "left_semi")
            edges = common.written(candidates(_printed(texts, turn).join(near, "node")), "candidates")
        more = confirmed(nearest(edges if told is None else edges.join(told, ["a", "b"], "left_anti")), texts)
        told = more if told is None else told.unionByName(more)
        if not more.where("alike").isEmpty():
            nodes = with_parts(nodes, more.where("alike"))
    common.tidy(spark)
    pairs = missed_pairs(rows, nodes)
    named = common.written(found.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node"), "named")
    more = confirmed(pairs, texts_of(rows, named))
    if not more.where("alike").isEmpty():
        nodes = with_parts(nodes, more.where("alike"))
    heads = nodes.groupBy("part").agg(F.min("least").alias("head"))
    return nodes.join(heads, "part").select("key", "rows", F.col("least.id").alias("least"), F.col("least.ties").alias("ties"), (F.col("least.key") == F.col("head.key")).alias("head"))


def _printed(texts: DataFrame, turn: int) -> DataFrame:
    """(node, w0, ...) of (node, text): fingerprints of the texts' shingles by the hashes of this turn. No shuffle."""

    def run(batches):
        for batch in batches:
            for start, length in blocks(batch.column(1)):
                prints = np.array([long_print(np.unique(shingle_hashes(t, NEAR_WORDS)), turn) for t in batch.column(1).slice(start, length).to_pylist()], U).reshape(-1, PRINT_WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length)] + [pa.array(prints[:, k].copy()) for k in range(PRINT_WORDS)], names=["node", *(f"w{k}" for k in range(PRINT_WORDS))])

    words = ", ".join(f"w{k} long" for k in range(PRINT_WORDS))
    return texts.select("node", "text").mapInArrow(run, f"node long, {words}")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without all but one of each group of `near_copies`: that with the smallest id.

    Rows are told apart by id and text, so rows that share an id, or have none, stay if their texts
    are no copies; of rows alike in both, one stays. Null and empty texts are alike: one of them
    stays. An empty table stays empty.
    """
    key, own = common.free(docs, "_key"), common.free(docs, "_own")
    text, number = F.coalesce(docs[text_col].cast("string"), F.lit("")), docs[id_col].cast("long")
    keyed = docs.withColumn(key, F.unhex(F.md5(text))).withColumn(own, number)
    fates = near_copies(docs.select(number.alias("id"), F.unhex(F.md5(text)).alias("key"), text.alias("text")))
    # Only texts of which some row may go are moved and joined.
    fates = common.written(fates.where("not head or rows > 1"), "fates").select(F.col("key").alias("_k"), "head", F.col("least").alias("_least"), "ties")
    may = membership(fates.select(F.xxhash64("_k")))
    whole = keyed.where(~may(F.xxhash64(keyed[key]))).select(*(keyed[c] for c in docs.columns))
    keyed = keyed.where(may(F.xxhash64(keyed[key])))
    told = keyed.join(fates, keyed[key] == fates["_k"], "left")
    stays = F.col("_k").isNull() | (F.col("head") & keyed[own].eqNullSafe(F.col("_least")))
    tied = F.coalesce(stays & (F.col("ties") > 1), F.lit(False))
    kept = whole.unionByName(told.where(stays & ~tied).select(*(keyed[c] for c in docs.columns)))
    if fates.where("head and ties > 1").isEmpty():
        return kept
    return kept.unionByName(told.where(tied).dropDuplicates([key]).select(*(keyed[c] for c in docs.columns)))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
