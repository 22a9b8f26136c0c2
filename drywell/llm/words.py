"""Words of whole texts as arrays: distinct words once, and for each text the numbers of its words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import blocks


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word numbers of all texts in order, where each text's words end). Null is empty."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words, index = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
    ends = offsets[1:] - offsets[0]
    if "" in words:  # what stands before the first and after the last word of a text
        full = index != words.index("")
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
        index = index[full]
    return words, index, ends


def words_of(text: str | None) -> list[str]:
    """The words of one text as `split_words` finds them: runs without ASCII white space."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])


def owners(ends: np.ndarray) -> np.ndarray:
    """The number of the text that each word stands in."""
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


__all__ = ["blocks", "owners", "split_words", "sums", "words_of"]
