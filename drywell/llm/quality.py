"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the counts of their joint votes estimates how accurate each is, without any given label, and so
the posterior of each vote pattern. A hashed linear scorer over words, word shapes and their pairs,
none of them a labeller's statistic, is then fitted to the posteriors of a bounded sample of distinct
texts and scores every document.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import blocks, owners, split_words, sums

#: Bounds: distinct texts that the linear scorer is fitted to at most, and hashed dimensions.
FIT_ROWS, DIMENSIONS = 8_000, 1 << 16
THRESHOLD = 0.3
GOOD, BAD, NONE = 1, 2, 0
SIGNS = re.compile(r"[#$%&*!|@^~<>{}=\\_]")
#: Labellers that look for one fault: (statistic, bad from). Without the fault they abstain.
FAULTS = {"signs": 0.20, "capitals": 0.20, "repeats": 0.20, "bars": 0.10, "sameness": 0.80, "top": 0.30, "marks": 0.25}
#: Labellers that look for running text: good if all of these statistics are at most so much. Else they abstain.
VIRTUES = (
    {"unlike": 0.10, "repeats": 0.05},
    {"sameness": 0.60, "top": 0.25, "repeats": 0.05},
    {"marks": 0.05, "capitals": 0.05, "bars": 0.02, "repeats": 0.05},
)
LABELLERS = (*FAULTS, "prose", "variety", "cleanness")
#: Labellers that judge only texts of at least so many words; shorter ones say little about repetition.
LEAST_WORDS = 8
STATS = ("signs", "capitals", "repeats", "bars", "sameness", "top", "marks", "unlike")
SCHEMA = "doc_id long, posterior double, score double, keep int"


def shape(word: str) -> str:
    """Runs of like signs, each as one: A capital, a small, 9 digit, else the sign itself."""
    out = ""
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return out


def statistics(texts: pa.Array):
    """(statistics by text and STATS, n words, distinct words, their shapes, word numbers, ends)."""
    words, index, ends = split_words(texts)
    n = np.maximum(1, np.diff(ends, prepend=0))
    signs = np.fromiter((bool(SIGNS.search(w)) for w in words), float, len(words))
    capitals = np.fromiter((w.isupper() and len(w) > 1 for w in words), float, len(words))
    bars = np.fromiter((w.strip("|") == "" or "|" in w for w in words), float, len(words))
    shapes = [shape(w) for w in words]
    marks = np.fromiter((len(s) > 1 and not s[-1:].isalnum() and s[-1:] not in ".,;:?" for s in shapes), float, len(words))
    unlike = np.fromiter((s not in ("a", "A", "Aa", "a.", "a,", "Aa.", "Aa,", "A.", "A,") for s in shapes), float, len(words))
    own = owners(ends)
    again = np.zeros(len(index))
    again[1:] = (index[1:] == index[:-1]) & (own[1:] == own[:-1])
    out = np.zeros((len(ends), len(STATS)))
    for k, v in enumerate((signs[index], capitals[index], again, bars[index])):
        out[:, k] = sums(v, ends) / n
    pairs, counts = np.unique(own * max(1, len(words)) + index, return_counts=True)
    of = pairs // max(1, len(words))
    distinct = np.bincount(of, minlength=len(ends))
    top = np.zeros(len(ends))
    np.maximum.at(top, of, counts)
    # Long texts repeat common words; distinct words are held against the square-root law of running text.
    out[:, 4] = 1 - np.minimum(1, distinct / np.minimum(n, 6 * np.sqrt(n)))
    out[:, 5] = top / n
    out[:, 6] = sums(marks[index], ends) / n
    out[:, 7] = sums(unlike[index], ends) / n
    return out, np.diff(ends, prepend=0), words, shapes, index, ends


def votes(stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each labeller's vote for each text: GOOD, BAD or NONE. Texts without words get no vote."""
    out = np.zeros((len(stats), len(LABELLERS)), np.int64)
    for k, (stat, bad) in enumerate(FAULTS.items()):
        out[stats[:, STATS.index(stat)] >= bad, k] = BAD
        if stat in ("repeats", "sameness", "top"):
            out[n < LEAST_WORDS, k] = NONE
    for k, most in enumerate(VIRTUES, len(FAULTS)):
        out[np.all([stats[:, STATS.index(s)] <= x for s, x in most.items()], axis=0), k] = GOOD
    out[n == 0] = NONE
    return out


def pattern_of(vote: np.ndarray) -> np.ndarray:
    return vote @ 3 ** np.arange(vote.shape[1])


def estimate(patterns: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """(posterior of good by pattern, P(vote | class) by labeller, class and vote, share of good).

    Expectation-maximisation with votes independent given the class. It starts from the share of
    votes that are good, and light pseudo-counts keep a labeller's error above zero and below half.
    """
    keys = np.array(sorted(patterns), np.int64)
    count = np.array([patterns[k] for k in keys.tolist()], float)
    m = len(LABELLERS)
    vote = keys[:, None] // 3 ** np.arange(m) % 3
    good, bad = (vote == GOOD).sum(1), (vote == BAD).sum(1)
    post = (good + 1.5) / (good + 3 * bad + 2)
    table, share = np.zeros((m, 2, 3)), 0.8
    for _ in range(rounds):
        share = ((count * post).sum() + 8) / (count.sum() + 10)
        for k in range(m):
            for c, w in ((1, count * post), (0, count * (1 - post))):
                said = np.bincount(vote[:, k], w, minlength=3) + np.array([1.0, 1.0 if c else 0.2, 0.2 if c else 1.0])
                table[k, c] = said / said.sum()
        log = np.array([np.log(table[:, c, :])[np.arange(m), vote].sum(1) for c in (0, 1)])
        now = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - share) - log[1] - np.log(share), -50, 50)))
        done = np.abs(now - post).max() < 1e-9 if len(post) else True
        post = now
        if done:
            break
    return dict(zip(keys.tolist(), post.tolist())), table, share


def hashed(names: list[str], salt: str) -> np.ndarray:
    return np.fromiter((zlib.crc32(f"{salt}{x}".encode("utf-8", "surrogatepass")) for x in names), np.int64, len(names))


def document_features(words: list[str], shapes: list[str], index: np.ndarray, ends: np.ndarray):
    """Hashed features as (text, dimension, value), roots of shares of a text's words: words in lower case, shapes, pairs of neighbouring shapes that say whether the words are the same, and a bias."""
    own = owners(ends)
    shape = hashed(shapes, "s ")[index]
    follows = own[1:] == own[:-1]
    pairs = ((shape[:-1] * 31 + shape[1:]) * 2 + (index[1:] == index[:-1]) + 7)[follows]
    text, dim, value = [], [], []
    for of, number in ((own, hashed([w.lower() for w in words], "w ")[index]), (own, shape), (own[1:][follows], pairs)):
        keys, counts = np.unique(of * DIMENSIONS + number % (DIMENSIONS - 1), return_counts=True)
        text.append(keys // DIMENSIONS)
        dim.append(keys % DIMENSIONS)
        value.append(np.sqrt(counts / np.bincount(of, minlength=len(ends))[text[-1]]))
    text.append(np.arange(len(ends)))
    dim.append(np.full(len(ends), DIMENSIONS - 1))
    value.append(np.ones(len(ends)))
    return np.concatenate(text), np.concatenate(dim), np.concatenate(value)


def train(text: np.ndarray, dim: np.ndarray, value: np.ndarray, target: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights for soft targets, by full-batch steps scaled by past gradients."""
    w, past = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    for _ in range(rounds if len(target) else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, value * w[dim], len(target)), -30, 30)))
        g = np.bincount(dim, value * (p - target)[text], DIMENSIONS) / len(target) + decay * w
        past += g * g
        w -= rate * g / np.sqrt(past)
    return w


def sample(texts: DataFrame, most: int) -> DataFrame:
    """(key, text): at most `most` distinct texts of (text), those with the smallest hashes; all if there are fewer."""
    keyed = texts.select(F.xxhash64("text").alias("key"), "text")
    drawn = keyed.select("key").distinct().orderBy("key").limit(most)
    return keyed.join(F.broadcast(drawn), "key").dropDuplicates(["key"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, float], np.ndarray]:
    """(posterior by pattern, weights). Votes are counted over all documents; the weights are fitted to at most FIT_ROWS distinct texts.

    Null texts are empty. Without documents there are no posteriors and all weights are zero.
    """
    common.prepare(docs.sparkSession)
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def count(batches):
        for batch in batches:
            for start, length in blocks(batch.column(0)):
                stats, n, *_ = statistics(batch.column(0).slice(start, length))
                found, counts = np.unique(pattern_of(votes(stats, n)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["pattern", "n"])

    patterns = {r["pattern"]: r["n"] for r in texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # 3 ** labellers at most
    posterior, _, _ = estimate(patterns)

    def features(batches):
        for batch in batches:
            for start, length in blocks(batch.column(1)):
                stats, n, *own = statistics(batch.column(1).slice(start, length))
                text, dim, value = document_features(*own)
                order = np.lexsort((dim, text))
                cut = np.searchsorted(text[order], np.arange(len(stats) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(x[order].astype(t))) for x, t in ((dim, np.int32), (value, np.float32))]
                target = np.array([posterior[p] for p in pattern_of(votes(stats, n)).tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), *lists, pa.array(target)], names=["key", "dim", "value", "target"])

    # Sorted here, where the bounded sample comes together, so the fit doesn't depend on the order of tasks.
    rows = sample(texts, FIT_ROWS).mapInArrow(features, "key long, dim array<int>, value array<float>, target double").toArrow().sort_by("key")
    sizes = np.asarray(rows["dim"].combine_chunks().value_lengths()) if len(rows) else np.zeros(0, int)
    flat = [np.asarray(rows[c].combine_chunks().flatten()) if len(rows) else np.zeros(0) for c in ("dim", "value")]
    weights = train(np.repeat(np.arange(len(rows)), sizes), flat[0].astype(np.int64), flat[1].astype(float), np.asarray(rows["target"], dtype=float))
    return posterior, weights


def scored(texts: pa.Array, posterior: dict[int, float], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior, score) of each text; the score is the linear scorer's. Null is empty."""
    stats, n, *own = statistics(texts)
    post = np.array([posterior.get(p, 0.5) for p in pattern_of(votes(stats, n)).tolist()])
    text, dim, value = document_features(*own)
    return post, 1 / (1 + np.exp(-np.clip(np.bincount(text, value * weights[dim], len(stats)), -30, 30)))


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, posterior, score, keep) of every row, by its text only.

    Null and empty texts have no words and no votes; they get the scorer's value for a text without
    words. A null id stays null, repeated rows score alike, other columns are not read.
    """
    common.prepare(docs.sparkSession)
    posterior, weights = model

    def run(batches):
        for batch in batches:
            for start, length in blocks(batch.column(1)):
                p, s = scored(batch.column(1).slice(start, length), posterior, weights)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), pa.array(p), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "posterior", "score", "keep"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold.

    Null texts score as empty ones; rows alike in text go or stay together, null and repeated ids make
    no difference; an empty table stays empty.
    """
    common.prepare(docs.sparkSession)
    posterior, weights = model
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for start, length in blocks(batch.column(at)):
                own = batch.slice(start, length)
                yield own.filter(pa.array(scored(own.column(at), posterior, weights)[1] >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_quality(docs, fit(docs))
