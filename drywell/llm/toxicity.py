"""Toxicity: Levenshtein automata intersected with a lexicon trie, hits weighed by their context.

The lexicon is learned: words and stems that labelled toxic rows share and clean rows lack. Its trie
and the Levenshtein automaton of a word run in step as one automaton whose states, sets of (trie
node, edits), are made as words reach them; most words reach its dead state after a few signs. A hit
counts less if its context window shows quotation (quotation marks around it, verbs of reporting),
and a logistic model over the hits of a text, fitted to the labels, gives the score.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .words import blocks, owners, split_words, words_of

#: The bound of the fit, labelled rows that it reads, and how far a context reaches. Terms and misspellings are bounded by those rows alone.
FIT_ROWS, WINDOW = 20_000, 8
#: Fewest toxic rows that a term must stand in, whatever chance says, and the signs of the shortest and longest stem.
LEAST_ROWS, STEMS = 4, range(4, 9)
THRESHOLD = 0.3
MARKS = "\"'«»“”„‘’‹›`"
STRIP = ".,;:!?()[]{}<>*#$%&|~^+=/\\_-" + MARKS
#: Verbs of reporting in the corpus languages.
REPORTING = set("said says say wrote writes called calls quoted quote quotes reported reports claimed stated dit écrit cite appelé sagte sagt schrieb zitiert nannte dijo dice escribió cita llamó".split())
#: Prior weights of a direct hit, a quoted hit, a misspelled hit, the density of hits, and the bias.
PRIOR = np.array([4.0, 1.0, 1.5, 1.0, -4.0])
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def edits(length: int, stem: bool) -> int:
    """Edits that a term of so many signs may hold; a stem's end is open, so it takes fewer."""
    return 0 if length < 5 + stem else 1 if length < 9 + stem else 2


class Lexicon:
    """match(word): None, or (term, edits) of the term that fits with the fewest edits."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach: list[int] = [0]  # the most edits that a term below allows
        for k, (term, stem) in enumerate(terms):
            node, most = 0, edits(len(term), stem)
            self.reach[0] = max(self.reach[0], most)
            for c in term:
                to = self.child[node].get(c)
                if to is None:
                    to = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.reach.append(0)
                node = to
                self.reach[node] = max(self.reach[node], most)
            self.ends[node].append(k)
        self.sets: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.step: dict[tuple[int, str], int] = {}
        self.done: list[tuple[int, int] | None] = []  # accepted if the word ends here
        self.open: list[tuple[int, int] | None] = []  # a stem accepted whatever follows
        self.start = self._number({0: 0})

    def _number(self, nodes: dict[int, int]) -> int:
        """The state of these trie nodes with their fewest edits, after signs of terms are left out."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            for to in self.child[node].values():
                e = nodes[node] + 1
                if e <= self.reach[to] and e < nodes.get(to, 99):
                    nodes[to] = e
                    todo.append(to)
        key = tuple(sorted(nodes.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            hits = [(e, k) for node, e in key for k in self.ends[node] if e <= edits(len(self.terms[k][0]), self.terms[k][1])]
            stems = [x for x in hits if self.terms[x[1]][1]]
            self.done.append(min(hits) if hits else None)
            self.open.append(min(stems) if stems else None)
        return self.numbers[key]

    def _next(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.sets[state]:
            to = self.child[node].get(c)
            if to is not None and e < out.get(to, 99):
                out[to] = e
            if e + 1 <= self.reach[node] and e + 1 < out.get(node, 99):  # the word has a sign more
                out[node] = e + 1
            for x, to in self.child[node].items():  # another sign in its place
                if x != c and e + 1 <= self.reach[to] and e + 1 < out.get(to, 99):
                    out[to] = e + 1
        to = self.step[state, c] = self._number(out)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        state, best, step = self.start, None, self.step
        for c in word:
            to = step.get((state, c))
            state = self._next(state, c) if to is None else to
            if not self.sets[state]:
                break
            hit = self.open[state]
            if hit is not None and (best is None or hit < best):
                best = hit
        else:
            hit = self.done[state]
            if hit is not None and (best is None or hit < best):
                best = hit
        return best and (self.terms[best[1]][0], best[0])


def core_of(word: str) -> str:
    return word.strip(STRIP).lower()


def features(texts: pa.Array, lexicon: Lexicon, seen: dict[str, float]) -> np.ndarray:
    """For each text: direct, quoted and misspelled hits, the density of hits, and 1.

    seen: of misspelled words that the fit met, the share of toxic rows among the rows that hold them.
    """
    words, index, ends = split_words(texts)
    hit, quote = np.zeros(len(words)), np.zeros(len(words), np.int8)
    wrong = np.zeros(len(words), bool)
    for k, word in enumerate(words):
        core = core_of(word)
        if core and (found := lexicon.match(core)):
            hit[k] = 1.0 if not found[1] else seen.get(core, 0.6)
            wrong[k] = found[1] > 0
        if word[:1] in MARKS or word[-1:] in MARKS or core in REPORTING:
            quote[k] = 2 * (word[:1] in MARKS and bool(word)) + 4 * (word[-1:] in MARKS and bool(word)) or 1
            quote[k] |= core in REPORTING
    n, own = len(texts), owners(ends)
    out = np.zeros((n, 5))
    out[:, 4] = 1
    at = np.flatnonzero(hit[index])
    if len(at):
        starts = ends - np.diff(ends, prepend=0)
        flags = quote[index]
        for p in at.tolist():
            d = own[p]
            before, after = flags[max(starts[d], p - WINDOW) : p + 1], flags[p : min(ends[d], p + WINDOW + 1)]
            quoted = ((before & 2).any() and (after & 4).any()) or (before & 1).any()
            value = hit[index[p]]
            out[d, 2 if wrong[index[p]] else 1 if quoted else 0] += value * (0.5 if quoted and wrong[index[p]] else 1)
        out[:, 3] = out[:, :3].sum(1) / np.sqrt(np.maximum(1, np.diff(ends, prepend=0)))
        out[:, :3] = np.log2(1 + out[:, :3])
    return out


def score(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """At most FIT_ROWS labelled rows' (text, toxic), never of the held-out part, stored in the shared folder.

    The labels are drawn by a hash of their id first; so few that they can be broadcast. Labels that
    repeat an id count once, as toxic if any is; a null label or id counts not at all. Of documents
    that repeat an id the text with the smallest hash counts.
    """
    drawn = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("_id is not null and toxic is not null").where(~held_out(F.col("_id")))
        .groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS)
    )
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    own = rows.join(F.broadcast(drawn), "_id").groupBy("_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "toxic")).alias("m"))
    return common.written(own.select("m.text", "m.toxic"), "labelled")


def stems_of(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEMS if k < len(word)]


def learn_terms(rows: DataFrame) -> list[tuple[str, bool]]:
    """Words and stems that toxic rows share beyond chance and clean rows all but lack: all that pass, however many."""

    def count(batches):
        for batch in batches:
            pos: Counter = Counter()
            neg: Counter = Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {w for w in map(core_of, set(words_of(text))) if len(w) > 2 and not w.isnumeric()}
                stems = {x for w in own for x in stems_of(w)}
                (pos if toxic else neg).update(own)
                (pos if toxic else neg).update(stems)
            terms = [t for t in pos | neg]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())], names=["term", "pos", "neg"])

    texts = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in texts.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return []
    base = total[1] / (total[0] + total[1])
    table = texts.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = common.written(table.withColumn("n", F.col("pos") + F.col("neg")).where("n > 2"), "terms")
    # The fewest toxic rows at which all terms together would be found by chance less than half a time.
    chance, least = 0.0, 99
    for r in table.groupBy(F.least("n", F.lit(60)).alias("n")).count().orderBy(F.desc("n")).collect():
        chance += r["count"] * base ** r["n"]
        if chance >= 0.5:
            break
        least = r["n"]
    least = max(LEAST_ROWS, least)
    wanted = {r["term"] for r in table.where((F.col("pos") >= least) & (F.col("pos") >= 19 * F.col("neg"))).select("term").collect()}

    def contexts(batches):
        for batch in batches:
            out = set()
            for text in batch.column(0).to_pylist():
                found = {}
                own = [core_of(w) for w in words_of(text)]
                for k, w in enumerate(own):
                    for term in (w, *stems_of(w)):
                        if term in wanted and term not in found:
                            found[term] = " ".join(own[max(0, k - 1) : k] + own[k + 1 : k + 2])
                out.update(found.items())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=["term", "context"])

    # Near copies repeat a word with its neighbours; what counts is in how many surroundings a term stands.
    found = texts.where("toxic > 0").select("text").mapInArrow(contexts, "term string, context string").distinct().groupBy("term").count().where(F.col("count") >= least).collect()
    return chosen_terms({r["term"]: r["count"] for r in found})


def chosen_terms(count: dict[str, int]) -> list[tuple[str, bool]]:
    """Of terms with their numbers of surroundings those that no other stands for, the frequent before the rare."""
    stems = sorted(t for t in count if t.endswith("*"))
    held: set[str] = set()  # chosen stems
    begins: dict[str, int] = {}  # of each beginning of a chosen term, its largest number
    chosen: list[str] = []
    for term, n in sorted(count.items(), key=lambda x: (-x[1], x[0].endswith("*"), -len(x[0]), x[0])):
        stem = term.endswith("*")
        if stem:  # the longest stem that stands in all but the same places is the least likely to hit other words
            at, head, like = bisect_left(stems, term[:-1]), term[:-1], [term]
            while at < len(stems) and stems[at].startswith(head):
                if count[stems[at]] >= 0.95 * n:
                    like.append(stems[at])
                at += 1
            term = max(like, key=lambda t: (len(t), t))
        core = term.rstrip("*")
        if any(core[:k] in held for k in range(1, len(core) + 1)) or (stem and begins.get(core, 0) >= 0.9 * n):
            continue
        chosen.append(term)
        if stem:
            held.add(core)
        for k in range(1, len(term) + 1):
            begins[term[:k]] = max(n, begins.get(term[:k], 0))
    return [(t.rstrip("*"), t.endswith("*")) for t in chosen]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[str, bool]], dict[str, float], np.ndarray]:
    """(terms, shares of misspelled words, weights), from at most FIT_ROWS labelled rows. Without labels: no terms, prior weights."""
    common.prepare(docs.sparkSession)
    rows = labelled(docs, labels, id_col, text_col)
    terms = learn_terms(rows)
    if not terms:
        return terms, {}, PRIOR

    def near(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(w, toxic) for w in {core_of(w) for w in set(words_of(text))} if w and (m := lexicon.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["word", "toxic"])

    counted = rows.mapInArrow(near, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).collect()
    base = 0.1
    seen = {r["word"]: (r["pos"] + 2 * 0.6) / (r["n"] + 2) for r in counted}
    # A misspelling found in clean rows about as often as in any is a word of its own.
    seen = {w: max(0.0, (s - base) / (1 - base)) for w, s in seen.items()}

    def rows_of(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            for start, length in blocks(batch.column(0)):
                x = features(batch.column(0).slice(start, length), lexicon, seen)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), batch.column(1).slice(start, length).cast(pa.int64())], names=["a", "b", "c", "d", "toxic"])

    data = rows.mapInArrow(rows_of, "a double, b double, c double, d double, toxic long").groupBy("a", "b", "c", "d", "toxic").count().orderBy("a", "b", "c", "d", "toxic").toPandas()
    x = np.column_stack([data[["a", "b", "c", "d"]].to_numpy(float), np.ones(len(data))])
    return terms, seen, logistic(x, data["toxic"].to_numpy(float), data["count"].to_numpy(float), PRIOR)


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Newton steps for the weights, pulled towards the prior."""
    w = prior.copy()
    for _ in range(50):
        p = score(x, w)
        gradient = x.T @ (n * (p - y)) + pull * (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    w[:4] = np.maximum(w[:4], 0)  # more hits never lower a score
    return w


def score_toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, by its text only.

    Null and empty texts have no hits and score as such; a null id is kept as null and not held out;
    repeated rows score alike; other columns are not read. Nothing is shuffled.
    """
    common.prepare(docs.sparkSession)
    terms, seen, weights = model

    def run(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            for start, length in blocks(batch.column(2)):
                s = score(features(batch.column(2).slice(start, length), lexicon, seen), weights)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), batch.column(1).slice(start, length), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold.

    Null and empty texts hold no term and stay; rows alike in text go or stay together; an empty table
    stays empty.
    """
    common.prepare(docs.sparkSession)
    terms, seen, weights = model
    at = docs.columns.index(text_col)

    def run(batches):
        lexicon = Lexicon(terms)
        for batch in batches:
            for start, length in blocks(batch.column(at)):
                own = batch.slice(start, length)
                yield own.filter(pa.array(score(features(own.column(at), lexicon, seen), weights) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, common.table(spark, sf_dir, "labels")))
