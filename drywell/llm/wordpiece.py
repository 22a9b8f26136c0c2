"""Token counts: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary's trie gets failure links: when no child takes the next sign, the automaton pops the
pieces that the longest match settles and goes on from the node of what is left. Only the number of
popped pieces is stored with each link, so a word is counted in one pass without building pieces.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common
from .tokens import blocks

VOCABULARY = "piece_bpe_32k.model"
MEMO_WORDS = 300_000
SCHEMA = "doc_id long, n_words long, n_tokens long"


def load_pieces(path: str) -> list[str]:
    """The plain pieces of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def greedy_count(word: str, pieces: set[str], longest: int, mark: str = "▁") -> int:
    """The plain definition, for tests: at each place the longest piece, else one piece for each UTF-8 byte of a sign."""
    text, at, n = mark + word, 0, 0
    while at < len(text):
        for stop in range(min(len(text), at + longest), at, -1):
            if text[at:stop] in pieces:
                n, at = n + 1, stop
                break
        else:
            n, at = n + len(text[at].encode("utf-8", "surrogatepass")), at + 1
    return n


class Automaton:
    """Nodes are numbers, 0 the root; child[node << 21 | code point] is a node."""

    def __init__(self, pieces: list[str], mark: str = "▁"):
        self.mark = mark
        child: dict[int, int] = {}
        final, edges = [False], [[]]
        for piece in pieces:
            node = 0
            for c in map(ord, piece):
                key = node << 21 | c
                if key not in child:
                    child[key] = len(final)
                    edges[node].append((c, len(final)))
                    final.append(False)
                    edges.append([])
                node = child[key]
            final[node] = final[node] or bool(piece)
        self.child, fail, pops = child, [0] * len(final), [0] * len(final)
        todo = deque((node, 0, c) for c, node in edges[0])
        while todo:
            node, parent, c = todo.popleft()
            if final[node]:
                fail[node], pops[node] = 0, 1
            else:
                at, n = (0, utf8_size(c)) if parent == 0 else self._settle(fail[parent], pops[parent], c, fail, pops)
                fail[node], pops[node] = at, n
            todo.extend((to, node, sign) for sign, to in edges[node])
        self.fail, self.pops = fail, pops

    def _settle(self, at: int, n: int, c: int, fail: list[int], pops: list[int]) -> tuple[int, int]:
        """From node `at` with n pieces popped, take sign c: the node then, and the pieces popped."""
        child = self.child
        while (to := child.get(at << 21 | c)) is None:
            if at == 0:
                return 0, n + utf8_size(c)
            n, at = n + pops[at], fail[at]
        return to, n

    def count(self, word: str) -> int:
        child, fail, pops, at, n = self.child, self.fail, self.pops, 0, 0
        for c in map(ord, self.mark + word):
            while (to := child.get(at << 21 | c)) is None:
                if at == 0:
                    n, to = n + utf8_size(c), 0
                    break
                n, at = n + pops[at], fail[at]
            at = to
        while at:
            n, at = n + pops[at], fail[at]
        return n


def utf8_size(c: int) -> int:
    return 1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4


_made: dict[str, tuple[Automaton, dict[str, int]]] = {}


def counter(path: str) -> tuple[Automaton, dict[str, int]]:
    """One automaton and word memo for each Python worker and vocabulary."""
    if path not in _made:
        _made[path] = Automaton(load_pieces(path)), {"": 0}
    return _made[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row: words are runs without ASCII white space, n_tokens their greedy pieces.

    Null and empty texts count 0; a null id stays null; repeated rows each give a row; other columns
    are not read. Whole texts are counted in blocks of bounded size; nothing is shuffled.
    """
    common.prepare(docs.sparkSession)

    def run(batches):
        automaton, memo = counter(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, length in blocks(texts):
                split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(start, length), "").cast(pa.large_string()))
                words = split.flatten().dictionary_encode()
                counts = []
                for word in words.dictionary.to_pylist():
                    n = memo.get(word)
                    if n is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                            memo[""] = 0
                        n = memo[word] = automaton.count(word)
                    counts.append(n)
                index = np.asarray(words.indices)
                each = np.array([*counts, 0], np.int64)[index]
                full = np.array([*map(bool, words.dictionary.to_pylist()), False], np.int64)[index]
                ends = np.asarray(split.offsets).astype(np.int64) - int(split.offsets[0].as_py())
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[ends]) for x in (full, each)]
                yield pa.RecordBatch.from_arrays([ids.slice(start, length), *map(pa.array, sums)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import tokenizer_path

    return count_tokens(common.table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))
