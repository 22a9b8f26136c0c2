"""Links between the tokens of two tokenizers over the same bytes, and how many documents hold each link.

The cumulative ends of both sides' tokens are merged with two pointers; where both end, a group is
complete, and all its tokens of one side are linked with all of the other. Byte-level BPE with the
usual pattern and merge-type pieces both end tokens before a space that follows a visible sign, so
the merge of each distinct piece of text between such places is made once and holds wherever it stands.
Spark counts the documents of each pair of ids and joins the counts and both sides' maxima back. Pairs
that very many documents hold are few by arithmetic and are broadcast; the others are joined by shuffle.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import BYTE, MARK, vocabulary
from .pieces import VOCABULARY as SECOND
from .segments import cut, spaced
from .tokens import blocks, byte_alphabet, tokenizer_path

FIRST = "byte_bpe_50k.json"
#: Fixed value: the pattern by which byte-level BPE splits texts.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: At most so many pairs are broadcast: those in more than a FREQUENT-th of all (document, pair) rows.
FREQUENT = 50_000
#: Pieces of text that a worker remembers, about 400 bytes each; of a group with more links than LARGE they are counted by id first.
MEMO, LARGE, AT_ONCE = 240_000, 1024, 2_000
#: Ids are strings on the way, as pandas has no whole numbers beside nulls.
TOKENS = "row_id long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def merged_groups(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Two pointers over cumulative token ends: (tokens of a, tokens of b) up to each common end. Both end together."""
    out, i, j = [], 0, 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            i += 1
            j += 1
            out.append((i, j))
        elif x < y:
            i += 1
        else:
            j += 1
    return out


class Aligner:
    """Groups and links of texts under a byte-level tokenizer file (A) and a merge-type vocabulary (B)."""

    def __init__(self, first: str, second: str):
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(first), vocabulary(second)
        self.a.encode_special_tokens = True
        told = json.loads(self.a.to_str())
        before = told.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or told.get("normalizer"):
            raise ValueError("the first tokenizer is not plain byte-level")
        if not self.b.apart:
            raise ValueError("the second vocabulary changes its texts, or has marks inside pieces")
        #: Whether A splits by the usual pattern and nothing else, so that texts can be cut.
        self.cuts = bool(before.get("use_regex", True)) and all(x.get("special") for x in told.get("added_tokens") or [])
        self.model, self.parts = self.a.model, regex.compile(PARTS)
        self.mapped = dict(enumerate(byte_alphabet()))
        back = {c: i for i, c in enumerate(byte_alphabet())}
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes([back[c] for c in token]) if all(c in back for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(self.b.pieces, self.b.kinds)]
        self.long_a, self.long_b = (list(map(len, x)) for x in (self.bytes_a, self.bytes_b))
        self.shift = len(self.bytes_b).bit_length()
        self.bits = self.shift + size.bit_length()
        self.long_a, self.long_b = np.array(self.long_a), np.array(self.long_b)
        # What each id looks like in a group: followed by another id, by the other side, by the next group.
        self.shown_a = [f"{i}{c}" for i in range(size) for c in ",|"]
        self.shown_b = [f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;"]
        self.forget()

    def forget(self) -> None:
        """An empty memo: the number of each piece of text known, and in columns its (n_a, n_b, n_groups, n_links), its groups as text, its links."""
        self.index: dict[str, int] = {}
        self.met = np.zeros(0, np.int32)  # in how many blocks each was met
        self.numbers, self.shown = np.zeros((0, 4), np.int64), []
        self.lost, self.sizes = np.zeros(0, bool), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def known(self, names: list[str]) -> np.ndarray:
        """Numbers of pieces of text in the memo; new ones are worked out first."""
        fresh = [x for x in names if x not in self.index]
        if len(self.index) + len(fresh) > MEMO and self.index:
            self.thin()
            fresh = [x for x in names if x not in self.index]
        if fresh:
            self.learn(fresh)
        found = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        self.met[found] += 1
        return found

    def thin(self) -> None:
        """Keeps what was met most often, a third of a full memo at most."""
        order = np.argsort(-self.met, kind="stable")[: MEMO // 3]
        kept = np.zeros(len(self.met), bool)
        kept[order[self.met[order] > 1]] = True
        links = np.repeat(kept, self.sizes)
        names = [x for x, k in zip(self.index, kept.tolist()) if k]
        self.index = dict(zip(names, range(len(names))))
        self.shown = [x for x, k in zip(self.shown, kept.tolist()) if k]
        self.pairs, self.times = self.pairs[links], self.times[links]
        self.met, self.numbers, self.lost, self.sizes = np.ones(len(names), np.int32), self.numbers[kept], self.lost[kept], self.sizes[kept]

    def first_ids(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of pieces of text and how many each has: by the library's model for each distinct part, or by the whole library where texts aren't cut."""
        if not self.cuts:
            found = [x.ids for k in range(0, len(names), AT_ONCE) for x in self.a.encode_batch_fast(names[k : k + AT_ONCE], add_special_tokens=False)]
        else:
            ids: dict[str, list[int]] = {}
            tokenize, mapped, found = self.model.tokenize, self.mapped, []
            for parts in map(self.parts.findall, names):
                own: list[int] = []
                for part in parts:
                    known = ids.get(part)
                    if known is None:
                        known = ids[part] = [t.id for t in tokenize(part.encode("utf-8", "surrogatepass").decode("latin-1").translate(mapped))]
                    own += known
                found.append(own)
        many = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(many.sum())), many

    def learn(self, names: list[str]) -> None:
        a, many_a = self.first_ids(names)
        b, many_b = self.b.flat(names)
        b = b.astype(np.int64)
        # A piece is lost if either side's tokens don't give its bytes back.
        data = [x.encode("utf-8", "surrogatepass") for x in names]
        same = lambda ids, many, table: np.array([x == y for x, y in zip(data, joined(ids, many, table))], bool)
        kept = same(a, many_a, self.bytes_a) & same(b, many_b, self.bytes_b)
        a, b = a[np.repeat(kept, many_a)], b[np.repeat(kept, many_b)]
        many_a, many_b = np.where(kept, many_a, 0), np.where(kept, many_b, 0)
        # Ends over all pieces one after the other: pieces are as long on either side, so groups end with them.
        ends = merged_groups(np.cumsum(self.long_a[a]).tolist(), np.cumsum(self.long_b[b]).tolist())
        p, q = (np.array(x, np.int64) for x in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 2
        n, m = np.diff(p, prepend=0), np.diff(q, prepend=0)
        owner = np.repeat(np.arange(len(names)), many_a)[p - 1]
        # Ids in the order of the text: of each group those of A, then those of B.
        group_a, group_b = np.repeat(np.arange(len(p)), n), np.repeat(np.arange(len(q)), m)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[p - 1] = last_b[q - 1] = True
        line: list = np.empty(len(a) + len(b), object)
        line[np.arange(len(a)) + (q - m)[group_a]] = np.array(self.shown_a, object)[a * 2 + last_a]
        line[np.arange(len(b)) + p[group_b]] = np.array(self.shown_b, object)[b * 2 + last_b]
        line = line.tolist()
        stops = np.cumsum(many_a + many_b).tolist()
        shown = ["".join(line[i:j]) for i, j in zip([0, *stops], stops)]
        # Links of small groups one by one, those of large ones counted by id first.
        links = n * m
        small = links <= LARGE
        each, first = links[small], (np.cumsum(links[small]) - links[small])
        r = np.arange(int(each.sum())) - np.repeat(first, each)
        wide = np.repeat(m[small], each)
        pairs = a[np.repeat((p - n)[small], each) + r // wide] << 32 | b[np.repeat((q - m)[small], each) + r % wide]
        times, of = np.ones(len(pairs), np.int32), np.repeat(owner[small], each)
        for k in np.flatnonzero(~small):
            (x, c), (y, d) = (np.unique(ids[e - w : e], return_counts=True) for ids, e, w in ((a, p[k], n[k]), (b, q[k], m[k])))
            pairs, times, of = np.append(pairs, (x[:, None] << 32 | y).ravel()), np.append(times, (c[:, None] * d).ravel()), np.append(of, np.full(len(x) * len(y), owner[k]))
        order = np.argsort(of, kind="stable")
        total = lambda x: np.bincount(owner, x, len(names)).astype(np.int64)
        self.index.update(zip(names, range(len(self.shown), len(self.shown) + len(names))))
        self.numbers = np.concatenate([self.numbers, np.stack([many_a, many_b, total(np.ones(len(p))), total(links)], axis=1)])
        self.shown += shown
        self.met = np.append(self.met, np.zeros(len(names), np.int32))
        self.lost, self.sizes = np.append(self.lost, ~kept), np.append(self.sizes, np.bincount(of, minlength=len(names)))
        self.pairs, self.times = np.append(self.pairs, pairs[order]), np.append(self.times, times[order])

    def rows(self, texts: pa.Array) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every text."""
        given = spaced(texts)
        if self.cuts:
            names, index, ends = cut(given)
        else:
            names = [x for x in given.to_pylist() if x]
            index, ends = np.arange(len(names)), np.cumsum([bool(x) for x in given.to_pylist()])
        number = self.known(list(dict.fromkeys(names)))
        if not self.cuts:
            number = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        own = number[index]
        before = lambda x: np.concatenate([np.zeros_like(x[:1]), np.cumsum(x, axis=0)]) if len(x) else np.zeros((1, *x.shape[1:]), x.dtype)
        starts = np.concatenate([[0], ends[:-1]])
        lost = np.diff(before(self.lost[own].astype(np.int64))[np.stack([starts, ends])], axis=0)[0] > 0
        sums = before(self.numbers[own])
        sums = np.where(lost[:, None], 0, sums[ends] - sums[starts])
        # All links of the texts as (text, pair), sorted together.
        doc = np.repeat(np.arange(len(ends)), np.where(lost, 0, ends - starts))
        own_kept = own[np.repeat(~lost, ends - starts)]
        size = self.sizes[own_kept]
        take = np.repeat((np.cumsum(self.sizes) - self.sizes)[own_kept] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pair, times = self.pairs[take], self.times[take]
        key = np.repeat(doc, size) << self.bits | (pair >> 32) << self.shift | pair & 0xFFFFFFFF
        if len(times) and times.max() > 1:
            key, which = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, which, times)
        else:
            key, total = np.unique(key, return_counts=True)
        stops = np.searchsorted(key >> self.bits, np.arange(len(ends)), "right").tolist()
        pair = key & (1 << self.bits) - 1
        pair = pair >> self.shift << 32 | pair & (1 << self.shift) - 1
        out, at, own = [], 0, own.tolist()
        for k, (i, j) in enumerate(zip(starts.tolist(), ends.tolist())):
            sha = hashlib.sha256("".join(map(self.shown.__getitem__, own[i:j]))[:-1].encode()).hexdigest() if j > i and not lost[k] else ""
            out.append((*sums[k].tolist(), sha, pair[at : stops[k]], total[at : stops[k]]))
            at = stops[k]
        return out


def joined(ids: np.ndarray, many: np.ndarray, table: list[bytes]):
    """The bytes of each run of ids."""
    each, at = list(map(table.__getitem__, ids.tolist())), 0
    for stop in np.cumsum(many).tolist():
        yield b"".join(each[at:stop])
        at = stop


_made: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """One aligner for each Python worker and pair of files."""
    if (first, second) not in _made:
        _made[first, second] = Aligner(first, second)
    return _made[first, second]


def aligned(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored row per row of docs: numbers of tokens, groups and links, the groups' digest, and its distinct id pairs (A << 32 | B) with their occurrences."""

    def run(frames):
        own = aligner(first, second)
        for frame in frames:
            texts = pa.array(frame["text"], pa.string(), from_pandas=True)
            for start, length in blocks(texts, 1_000_000):
                part = frame.iloc[start : start + length]
                columns = list(zip(*own.rows(texts.slice(start, length))))
                names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                yield pd.DataFrame({"row_id": part["row_id"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), **dict(zip(names, map(list, columns)))})

    given = docs.select(F.monotonically_increasing_id().alias("row_id"), docs[id_col].cast("long").cast("string").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return common.written(given.mapInPandas(run, TOKENS), "aligned")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, docs, best_a, best_b) of (row_id, pair, ...), a row for each document and pair: in how many documents, and the most of any pair of its A id, of its B id."""
    counts = common.written(links.groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    a, b = F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")
    sides = counts.select("pair", "docs", a, b)
    best_a = sides.groupBy("a").agg(F.max("docs").alias("best_a"))
    best_b = sides.groupBy("b").agg(F.max("docs").alias("best_b"))
    return common.written(sides.join(best_a, "a").join(best_b, "b").select("pair", "docs", "best_a", "best_b"), "pair-maxima")


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_b.

    Null and empty texts, and those whose tokens don't give their bytes back on either side, have
    zeros and an empty digest. A null id stays null; rows that repeat an id or a text count as
    documents of their own; other columns are not read; an empty table gives no rows.
    """
    common.prepare(docs.sparkSession)
    rows = aligned(docs, first, second, id_col, text_col)
    zipped = F.explode(F.arrays_zip("pairs", "times")).alias("x")
    links = rows.select("row_id", zipped).select("row_id", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = pair_counts(links)
    total = counts.agg(F.sum("docs")).first()[0] or 0
    common_ = counts.where(F.col("docs") > total // FREQUENT)  # fewer than FREQUENT rows, as docs adds up to total
    rare = counts.where(F.col("docs") <= total // FREQUENT)
    sums = [
        F.sum(F.when(F.col("docs") == F.col("best_a"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.when(F.col("docs") == F.col("best_b"), F.col("times")).otherwise(0)).alias("n_best_b"),
        F.sum(F.col("docs") * F.col("times")).alias("count_sum"),
    ]
    often = links.join(F.broadcast(common_), "pair").groupBy("row_id").agg(*sums)
    seldom = links.join(F.broadcast(common_.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("row_id").agg(*sums)
    found = often.union(seldom).groupBy("row_id").agg(*(F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")))
    none = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_best", "count_sum", "n_best_b")}
    joined = rows.drop("pairs", "times").join(found, "row_id", "left").withColumns(none)
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_b")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"), tokenizer_path(FIRST), tokenizer_path(SECOND))
