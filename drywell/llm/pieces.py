"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's signs start as symbols; pairs of neighbours that form a piece stand on an agenda by score,
then by place, and the best is merged until none is left. A merged symbol meets its neighbours anew,
entries whose symbols have changed are passed over. Symbols that stay without a piece become bytes
where the vocabulary has them. If no piece holds a word mark behind another sign, no merge goes
across a cut before a space, so each distinct piece of text between cuts is worked out once; short
ones take their steps together, each the best entry of its own agenda, in arrays.

Every distinct piece of text is held against the sentencepiece library before it is used, every
decoded text against the library's (`whole`: and the ids of every whole text). A difference is an
error, never a result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from heapq import heapify, heappop, heappush
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .segments import Memo, cut, spaced
from .tokens import blocks, gather, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_SIGN = " ⁇ "
#: Numbers of the model file's message fields and of the kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGE_TYPE = 2
#: Pieces of text up to this many signs take their steps together.
SHORT = 64
NONE = np.int64(1) << 40
#: No text holds this byte: control pieces in the middle lead to the slow way of decoding.
NO_SIGN = b"\xff"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message: int, float or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError("not a model file")


class Vocabulary:
    """A merge-type model file: pieces with scores and kinds, and how texts are prepared."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer, normal, found = {}, {}, []
        for number, value in fields(self.library.serialized_model_proto()):
            if number == 1:
                own = dict(fields(value))
                found.append((own[1].decode(), own.get(2, 0.0), own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if trainer.get(3, 1) != MERGE_TYPE:
            raise ValueError("only merge-type (BPE) vocabularies")
        #: Pieces that merges can make: (negative score, id, unused).
        self.merges = {p: (-s, i, kind == UNUSED) for i, (p, s, kind) in enumerate(found) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        self.pieces, self.kinds = [p for p, _, _ in found], [k for _, _, k in found]
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(found) if k == BYTE} if trainer.get(35) else {}
        self.end = self.library.eos_id()
        frozen = sorted((p for p, _, k in found if k == USER_DEFINED), key=len, reverse=True)
        self.frozen = re.compile("|".join(map(re.escape, frozen))) if frozen else None
        #: Signs stay as they are, spaces become marks, one mark comes first.
        self.plain = not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1) and not trainer.get(24)
        self.apart = self.plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.merges)
        self.memo = Memo(self.made)
        self.together = not self.frozen and UNUSED not in self.kinds
        if self.together:
            self.tables()
        surface = {BYTE: lambda p: bytes([int(p[3:5], 16)]), CONTROL: lambda p: NO_SIGN, UNKNOWN: lambda p: UNKNOWN_SIGN.encode()}
        self.surface = [surface.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, k in zip(self.pieces, self.kinds)]

    def tables(self) -> None:
        """Numbers of signs, and of every pair of symbols that makes a piece: its rank by score and its id."""
        number = {p: i for p, (_, i, _) in self.merges.items()}
        for sign in sorted({c for p in self.merges for c in p} - number.keys()):  # only ever part of a piece
            number[sign] = -1 - ord(sign)
        self.sign = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.sign[ord(p)] = i
        order = {x: k for k, x in enumerate(sorted({x for x, _, _ in self.merges.values()}))}
        found = sorted(((number[p[:k]] << 32) + number[p[k:]], order[x], i) for p, (x, i, _) in self.merges.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.pair, self.rank, self.into = (np.array(x, np.int64) for x in zip(*found, (np.iinfo(np.int64).max, 0, 0)))

    def met(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what neighbours a, b make; rank NONE where they make nothing."""
        key = (a.astype(np.int64) << 32) + b
        at = np.searchsorted(self.pair, key)
        known = self.pair[at] == key
        return np.where(known, self.rank[at], NONE), self.into[at]

    def flat(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pieces of text that start with a space, one after the other, as 32-bit integers; how many each has), held against the library."""
        out: list = [None] * len(names)
        short = [k for k, x in enumerate(names) if len(x) <= SHORT] if self.together else []
        if short:
            signs = np.frombuffer("".join([names[k] for k in short]).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), np.uint32)
            lens = np.fromiter((len(names[k]) for k in short), np.int64, len(short))
            for k, ids in zip(short, self.steps(self.sign[signs], lens)):
                out[k] = ids
        for k, ids in enumerate(out):
            if ids is None:
                out[k] = np.array(self.merged(names[k].replace(" ", MARK)), np.int32).tobytes()
        # The library puts the first mark itself, but not before an empty text.
        known = self.library.encode([x[1:] for x in names], num_threads=1)
        if b"".join([a for a, x in zip(out, names) if x != " "]) != np.fromiter(chain.from_iterable(known), np.int32).tobytes():
            raise ValueError(f"not the library's ids: {next(x for x, a, y in zip(names, out, known) if x != ' ' and np.frombuffer(a, np.int32).tolist() != y)!r}")
        return np.frombuffer(b"".join(out), np.int32), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def made(self, names: list[str]) -> list[tuple[bytes, str]]:
        """Ids of each piece of text: as 32-bit integers, and in decimal."""
        ids, many = self.flat(names)
        numbers, data = list(map(str, ids.tolist())), ids.tobytes()
        stops = np.cumsum(many).tolist()
        return [(data[4 * i : 4 * j], " ".join(numbers[i:j])) for i, j in zip([0, *stops], stops)]

    def steps(self, sym: np.ndarray, lens: np.ndarray) -> list[bytes | None]:
        """Ids of short pieces; none for those with symbols left that aren't pieces. In each step every piece merges its best pair."""
        word = np.repeat(np.arange(len(lens)), lens)
        rank, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], into[inner] = self.met(sym[inner], sym[inner + 1])
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            sizes = np.diff(starts, append=len(word))
            agenda = rank * SHORT + (np.arange(len(word)) - np.repeat(starts, sizes))
            best = np.minimum.reduceat(agenda, starts)
            going = best < NONE * SHORT
            place = starts[going] + best[going] % SHORT
            live = np.repeat(going, sizes)
            ended.append((word[~live], sym[~live]))
            sym[place] = into[place]
            live[place + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[place] = True
            fresh[np.maximum(place - 1, 0)] = True
            sym, word, rank, into, fresh = sym[live], word[live], rank[live], into[live], np.flatnonzero(fresh[live])
            rank[fresh] = NONE
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh], into[fresh] = self.met(sym[fresh], sym[fresh + 1])
        words, ids = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(words, kind="stable")
        words, ids = words[order], ids[order].astype(np.int32)
        odd = np.flatnonzero(ids < 0)
        if len(odd) and not self.bytes:  # unknown neighbours are one: left to `merged`
            unknown = set(words[odd].tolist())
        else:
            unknown = set()
            signs, which = np.unique(ids[odd], return_inverse=True)
            spelt = [np.array([self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")], np.int32) for i in signs.tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = np.array([len(x) for x in spelt], np.int64)[which]
            at = np.cumsum(times) - times
            wide, words = np.repeat(ids, times), np.repeat(words, times)
            for k, own in enumerate(spelt):
                to = at[odd[which == k]]
                for j, i in enumerate(own.tolist()):
                    wide[to + j] = i
            ids = wide
        stops = (np.cumsum(np.bincount(words, minlength=len(lens))) * 4).tolist()
        data = ids.tobytes()
        return [None if k in unknown else data[a:b] for k, (a, b) in enumerate(zip([0, *stops], stops))]

    def symbols(self, text: str) -> tuple[list[str], set[int]]:
        """Signs and user-defined pieces in order; the latter are never merged."""
        if not self.frozen:
            return list(text), set()
        out, held, at = [], set(), 0
        for m in self.frozen.finditer(text):
            out += text[at : m.start()]
            held.add(len(out))
            out.append(m[0])
            at = m.end()
        return out + list(text[at:]), held

    def merged(self, text: str) -> list[int]:
        """Ids of a prepared text by the agenda."""
        merges = self.merges
        parts, held = self.symbols(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        halves: dict[str, tuple[str, str]] = {}
        agenda: list[tuple[float, int, int, int]] = []

        def meet(a: int, b: int):
            if a < 0 or b >= n or a in held or b in held:
                return None
            piece = parts[a] + parts[b]
            known = merges.get(piece)
            if known is None:
                return None
            if known[2]:
                halves[piece] = (parts[a], parts[b])
            return known[0], a, b, len(piece)

        agenda = [x for x in map(meet, range(n - 1), range(1, n)) if x]
        heapify(agenda)
        while agenda:
            _, a, b, size = heappop(agenda)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            for x in (meet(before[a], a), meet(a, after[a])):
                if x:
                    heappush(agenda, x)
        out: list[int] = []
        todo = [x for x in reversed(parts) if x]
        was_unknown = False
        while todo:
            piece = todo.pop()
            known = merges.get(piece)
            if known and known[2] and piece in halves:  # an unused piece falls back into its halves
                todo += halves[piece][::-1]
                continue
            if known:
                out.append(known[1])
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            elif not was_unknown:  # neighbours without a piece are one unknown
                out.append(self.unknown)
            was_unknown = not known
        return out

    def prepared(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.library.normalize(text)

    def coded(self, texts: pa.Array) -> tuple[list[tuple[bytes, str]], np.ndarray, np.ndarray]:
        """(ids of distinct pieces as bytes and in decimal, piece numbers of all texts in order, where each text's pieces end). Null is empty."""
        if self.apart:
            names, index, ends = cut(spaced(texts))
            return self.memo.all(names), index, ends
        found = [self.merged(self.prepared(x or "")) for x in texts.to_pylist()]
        each = np.arange(len(found))
        return [(np.array(x, np.int32).tobytes(), " ".join(map(str, x))) for x in found], each, each + 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and where each text's ids end. Null is empty."""
        return spread(*self.coded(texts))

    def decode(self, ids: list[int]) -> str:
        """The text of ids of a plain vocabulary: bytes that make no sign become U+FFFD each; the mark in front goes."""
        if not self.plain:
            return self.library.decode(ids)
        surface = self.surface
        if ids and ids[-1] == self.end:
            ids = ids[:-1]
        data = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        skip = 1 if first is not None and self.kinds[first] not in (BYTE, UNKNOWN) and self.pieces[first].startswith(MARK) else 0
        try:
            return data.decode()[skip:]
        except UnicodeDecodeError:  # bytes make signs only where nothing, not even a control piece, stands between
            runs = groupby(ids, lambda i: self.kinds[i] == BYTE)
            return "".join(b"".join(surface[i] for i in own if self.kinds[i] != CONTROL).decode("utf-8", "one_by_one") for _, own in runs)[skip:]


def spread(found: list[tuple[bytes, str]], index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lens = np.fromiter((len(x) for x, _ in found), np.int64, len(found)) // 4
    return gather(np.frombuffer(b"".join([x for x, _ in found]), np.int32), lens, index, ends)


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


_made: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker and path."""
    import codecs

    codecs.register_error("one_by_one", _one_by_one)
    if path not in _made:
        _made[path] = Vocabulary(path)
    return _made[path]


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; no shuffle.

    ids: the whole text's ids and the end id; their decimal forms joined by one space are hashed, as
    is the text that they decode to. A null text is empty (the end id alone, decoded to an empty
    text); null and repeated ids stay, other columns are not read, an empty table gives no rows. A
    vocabulary of another type is refused. Pieces of text whose ids, and rows whose decoded text,
    differ from the library's are an error that names them; `whole` also holds the ids of each whole
    text against the library, as is always done where the vocabulary allows no cuts.
    """
    common.prepare(docs.sparkSession)

    def run(batches):
        own = vocabulary(path)
        library, end = own.library, own.end
        for batch in batches:
            for start, length in blocks(batch.column(1), 4_000_000):
                doc, texts = batch.column(0).slice(start, length), batch.column(1).slice(start, length)
                found, index, ends = own.coded(texts)
                numbers = list(map([x for _, x in found].__getitem__, index.tolist()))
                flat, stops = spread(found, index, ends)
                flat, at = flat.tolist(), 0
                ids = []
                for stop in stops.tolist():
                    ids.append([*flat[at:stop], end])
                    at = stop
                back = library.decode(ids, num_threads=1)
                if (whole or not own.apart) and ids != library.encode([x or "" for x in texts.to_pylist()], num_threads=1, add_eos=True):
                    raise ValueError("not the library's ids of whole texts")
                hashed, at = [], 0
                for k, stop in enumerate(ends.tolist()):
                    if own.decode(ids[k]) != back[k]:
                        raise ValueError(f"row with id {doc[k].as_py()}: not the library's text")
                    hashed.append(hashlib.sha256(" ".join([*numbers[at:stop], str(end)]).encode()).hexdigest())
                    at = stop
                decoded = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back]
                yield pa.RecordBatch.from_arrays([doc, pa.array(list(map(len, ids)), pa.int64()), pa.array(hashed), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(common.table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
