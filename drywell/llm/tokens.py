"""Token ids of whole texts by the tokenizers library, with a bounded memo of parts of words.

The tokenizer whose file has the digest IN_PARTS (word_bpe_49k.json) composes, lower-cases, splits at white space and then into
contractions, runs of letters, single numbers and runs of other signs, and joins pairs within each
of those only. No step looks beyond those parts, so the ids of a text are those of its parts in order. With any
other tokenizer all texts go to the library whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NAME = "word_bpe_49k.json"
#: Fixed value: SHA-256 of the file whose rules for parts are known here, whatever its name.
IN_PARTS = "53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a"
#: A text of these signs only is composed already and lower-cases letter by letter; apostrophes are left out, as they may begin contractions.
LETTERS = "a-zß-öø-ÿ"
PLAIN = r"^[\x00-\x26\x28-\x7EÀ-ÖØ-öø-ÿ]*$"
APART = rf"([^\x20\x09-\x0D0-9{LETTERS}]+|[0-9])"
MEMO_PARTS = 500_000


def tokenizer_path(name: str = NAME) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The 256 printable stand-ins of byte-level BPE: printable Latin-1 signs stay, the others follow from 256."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in stays:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Encoder:
    """Text arrays to ids: distinct parts are looked up, unknown ones go to the library's model, other than plain texts wholly to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            data = f.read()
        self.whole = Tokenizer.from_buffer(data)
        #: Ids are below this.
        self.size = max(self.whole.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.in_parts = hashlib.sha256(data).hexdigest() == IN_PARTS
        self.model = self.whole.model
        self.alphabet = byte_alphabet()
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        """Ids of one lower-case part of a plain text."""
        mapped = part if part.isascii() and part.isprintable() else "".join(map(self.alphabet.__getitem__, part.encode()))
        return np.array([t.id for t in self.model.tokenize(mapped)], np.uint16).tobytes()

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        apart = pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \1 ")
        split = pc.ascii_split_whitespace(apart)
        ends = np.asarray(split.offsets)[1:].astype(np.int64) - int(split.offsets[0].as_py())
        parts = split.flatten().dictionary_encode()
        found, memo = [], self.parts
        for part in parts.dictionary.to_pylist():
            ids = memo.get(part)
            if ids is None:
                ids = self._part(part)
                if len(memo) >= MEMO_PARTS:
                    memo.clear()
                    memo[""] = b""
                memo[part] = ids
            found.append(ids)
        flat = np.frombuffer(b"".join(found), np.uint16)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 2
        return gather(flat, lens, np.asarray(parts.indices), ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (16 bits, 32 for large vocabularies) of all texts, one after the other, and the end of each text's ids. Null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.in_parts:
            found = [x.ids for x in self.whole.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([i for x in found for i in x], self.kind), np.cumsum([len(x) for x in found], dtype=np.int64)
        plain = np.asarray(pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring(texts, "<|"))))
        if plain.all():
            return self._plain(texts)
        own = self.whole.encode_batch(texts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        ids, ends = self._plain(texts.filter(pa.array(plain)))
        lens = np.zeros(len(texts), np.int64)
        lens[plain] = np.diff(ends, prepend=0)
        lens[~plain] = [len(x.ids) for x in own]
        stop = np.cumsum(lens)
        out = np.empty(int(stop[-1]), np.uint16)
        of = np.repeat(plain, lens)
        out[of] = ids
        out[~of] = np.array([i for x in own for i in x.ids], np.uint16)
        return out, stop


def gather(flat: np.ndarray, lens: np.ndarray, index: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of flat by index in order, and where the first ends[i] of them end."""
    starts = np.cumsum(lens) - lens
    take = lens[index]
    stop = np.cumsum(take)
    total = int(stop[-1]) if len(stop) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts[index] - (stop - take), take)
    upto = np.concatenate([[0], stop])
    return flat[at] if total else flat[:0], upto[ends]


_made: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and path."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def blocks(texts: pa.Array, most: int = 8_000_000):
    """Slices (start, length) of about `most` bytes, so that a batch of long texts stays small."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start = run = 0
    for i, s in enumerate(size):
        if run and run + s > most:
            yield start, i - start
            start, run = i, 0
        run += int(s)
    if start < len(size):
        yield start, len(size) - start
