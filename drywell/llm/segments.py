"""Cuts texts where a space follows something that isn't white space, and tells each distinct piece once.

No token of a byte-level BPE whose pre-tokenizer is the usual pattern, and none of a merge-type
vocabulary whose pieces have word marks in front only, goes across such a cut. So what is known of a
distinct piece holds wherever it stands, and is worked out once for each worker's memo.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 500_000


def spaced(texts: pa.Array) -> pa.Array:
    """Texts with a space before; null and empty texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))


def cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, piece numbers of all texts in order, where each text's pieces end) of texts made by `spaced`.

    A cut is before a space that follows a visible sign. What ends in bytes that a wide white space
    or a word mark (U+2581) could end in isn't cut, which only makes a piece longer.
    """
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: int(offsets[-1])] if len(texts) else np.zeros(0, np.uint8)
    at = np.flatnonzero(data == 0x20)
    one, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81) | (two == 0x96))) | ((three == 0xE3) & (two == 0x80)) | ((three == 0xE1) & (two == 0x9A))
    marked = np.zeros(len(data), bool)
    marked[at[(one > 0x20) & ~((one >= 0x80) & wide)]] = True
    marked[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(marked)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    names = [x.decode("utf-8", "surrogatepass") for x in pieces.dictionary.to_pylist()]
    return names, np.asarray(pieces.indices).astype(np.int64), np.searchsorted(starts, offsets[1:])


class Memo(dict):
    """What `make` finds for each piece; emptied when it holds too many."""

    def __init__(self, make, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most

    def all(self, names: list[str]) -> list:
        missing = [x for x in names if x not in self]
        if missing:
            if len(self) + len(missing) > self.most:
                self.clear()
                missing = names
            self.update(zip(missing, self.make(missing)))
        return [self[x] for x in names]
