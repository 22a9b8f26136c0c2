"""Leaf-wise boosted trees from histograms: best-first growth, L2, a learned direction for missing values.

Values are binned once. A round of a tree's growth is one pass over the rows: tasks count gradients by
(node, feature, bin) in arrays and pass only those on; of two children the smaller is counted, its sibling
is the parent less it. Rounds look ahead: all leaves that could still be split are, so a tree of 63 leaves
takes about as many rounds as it is deep, and what best-first order doesn't choose is left out again.
Gradients are whole numbers (fixed point), so sums, and with them the trees, do not depend on how rows
are dealt, or on tasks that run again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import finite
from ..functions.store import settled

BINS, MISSING = 255, 255
#: Gradients are counted in steps of 1 / FIXED.
FIXED = 1 << 24
#: Stored predictions are brought up to date after so many trees.
REFRESH = 8
#: Nearest to the settings that the reference results were made with.
PARAMS = {"trees": 800, "rate": 0.03, "leaves": 63, "least": 30, "l2": 0.0, "depth": 40}
HISTOGRAMS = "node long, feature int, g array<long>, n array<long>, gain double, cut int, missing_left boolean"


def edges_of(df: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last: quantiles of its finite values, each once."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*(F.percentile_approx(finite(F.col(f"`{c}`").cast("double")), shares, 100_000).alias(f"q{k}") for k, c in enumerate(names))).first()
    return [np.unique(np.array(x if x is not None else [], float)) for x in row]


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bins of values; missing ones have a bin of their own."""
    return np.where(np.isfinite(values), np.searchsorted(edges, np.nan_to_num(values), "left"), MISSING).astype(np.uint8)


def gain_of(g, n, l2: float):
    return np.where(n + l2 > 0, g * g / np.maximum(n + l2, 1e-300), 0.0)


def best_cut(g: np.ndarray, n: np.ndarray, least: int, l2: float) -> tuple[float, int, bool]:
    """(gain, last bin of the left side, whether missing values go left) of one feature's histogram; gain 0 for none. Ties: missing to the right, then the first bin."""
    g, n = np.asarray(g, float) / FIXED, np.asarray(n, float)
    own_g, own_n, all_g, all_n = np.cumsum(g[:MISSING]), np.cumsum(n[:MISSING]), g.sum(), n.sum()
    best = (0.0, -1, False)
    for left in (False, True) if n[MISSING] else (False,):
        lg, ln = own_g + (g[MISSING] if left else 0.0), own_n + (n[MISSING] if left else 0.0)
        gains = gain_of(lg, ln, l2) + gain_of(all_g - lg, all_n - ln, l2) - gain_of(all_g, all_n, l2)
        gains = np.where((ln >= least) & (all_n - ln >= least), gains, 0.0)
        k = int(gains.argmax())
        if gains[k] > best[0] + 1e-12:
            best = (float(gains[k]), k, left)
    return best


class Tree:
    """Arrays by place: feature (-1 for leaves), cut, missing_left, left, right, value; node numbers are 1 for the root, 2i and 2i + 1 below i."""

    def __init__(self, splits: dict[int, tuple[int, int, bool]], values: dict[int, float] | None = None):
        self.nodes = [1]
        for i in self.nodes:
            if i in splits:
                self.nodes += [2 * i, 2 * i + 1]
        at = {i: k for k, i in enumerate(self.nodes)}
        get = lambda j, d: np.array([splits[i][j] if i in splits else d for i in self.nodes])
        self.feature, self.cut, self.missing_left = get(0, -1), get(1, 0), get(2, False).astype(bool)
        self.left, self.right = (np.array([at[2 * i + s] if i in splits else k for k, i in enumerate(self.nodes)]) for s in (0, 1))
        self.value = np.array([(values or {}).get(i, 0.0) for i in self.nodes])

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The place of each row's leaf; bins: (rows, features)."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            b = bins[rows, np.maximum(feature, 0)]
            left = np.where(b == MISSING, self.missing_left[at], b <= self.cut[at])
            at = np.where(inner, np.where(left, self.left[at], self.right[at]), at)


class Forest:
    """Features by name, their bins, a first value and trees; predicts from arrays, so that tasks can use it on what they hold."""

    def __init__(self, names: list[str], edges: list[np.ndarray], first: float, trees: list[Tree]):
        self.names, self.edges, self.first, self.trees = names, edges, first, trees

    def __call__(self, given: dict[str, np.ndarray]) -> np.ndarray:
        missing = [n for n in self.names if n not in given]
        if missing:
            raise ValueError(f"missing features {missing[:10]}")
        bins = np.stack([binned(np.asarray(given[n], float), e) for n, e in zip(self.names, self.edges)], axis=1)
        return self.of_bins(bins)

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.first)
        for t in self.trees:
            out += t.value[t.place(bins)]
        return out

    def predict(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """df (or its columns `keep`) with `pred`."""
        missing = [n for n in self.names if n not in df.columns]
        if missing:
            raise ValueError(f"missing features {missing[:10]}")
        kept, forest = keep or df.columns, self
        held = [F.col(f"`{n}`").cast("double").alias(f"_x{k}") for k, n in enumerate(self.names)]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(f"`{c}`" for c in kept)).schema) + ", pred double"

        def run(batches):
            for batch in batches:
                given = {n: batch.column(len(kept) + k).to_numpy(zero_copy_only=False).astype(float) for k, n in enumerate(forest.names)}
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(forest(given))], names=[*kept, "pred"])

        return df.select(*(F.col(f"`{c}`") for c in kept), *held).mapInArrow(run, schema)


def prepared(df: DataFrame, names: list[str], edges: list[np.ndarray], label: str) -> DataFrame:
    """(x binary, y): a byte for each feature's bin, stored."""

    def run(batches):
        for batch in batches:
            y = batch.column(0)
            x = np.stack([binned(batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float), e) for k, e in enumerate(edges)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), y], names=["x", "y"])

    rows = df.select(finite(F.col(f"`{label}`").cast("double")).alias("y"), *(F.col(f"`{n}`").cast("double").alias(f"_x{k}") for k, n in enumerate(names)))
    return settled(rows.where("y IS NOT NULL").mapInArrow(run, "x binary, y double"))


def bins_of(column: pa.Array, features: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.reshape(-1, features)


def counted(rows: DataFrame, forest: Forest, since: int, tentative: Tree, wanted: list[int]) -> DataFrame:
    """(node, feature, g, n): each task's histograms of the rows in the nodes wanted of a tentative tree; rows have the predictions of the trees before `since`."""
    features = len(forest.names)
    place = {tentative.nodes.index(i): k for k, i in enumerate(wanted)}

    def run(batches):
        g, n = np.zeros((2, len(wanted) * features * 256))
        number = np.full(len(tentative.nodes), -1)
        number[list(place)] = list(place.values())
        for batch in batches:
            x, y, pred = bins_of(batch.column(0), features), np.asarray(batch.column(1)), np.asarray(batch.column(2)).copy()
            if not len(x):
                continue
            for t in forest.trees[since:]:
                pred += t.value[t.place(x)]
            node = number[tentative.place(x)]
            own = node >= 0
            x, node, error = x[own], node[own], np.rint((pred - y)[own] * FIXED)
            key = ((node[:, None] * features + np.arange(features)) * 256 + x).ravel()
            g += np.bincount(key, np.repeat(error, features), len(g))
            n += np.bincount(key, minlength=len(n))
        many = np.add.reduceat(n, np.arange(0, len(n), 256)) > 0
        at = np.flatnonzero(many)
        lists = lambda a: pa.array(list(a.reshape(-1, 256)[at].astype(np.int64)), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.array(wanted, np.int64)[at // features]), pa.array((at % features).astype(np.int32)), lists(g), lists(n)], names=["node", "feature", "g", "n"])

    return rows.mapInArrow(run, "node long, feature int, g array<long>, n array<long>")


def histograms(parts: DataFrame, parents: DataFrame | None, least: int, l2: float) -> DataFrame:
    """(node, feature, g, n, and the feature's best cut) of the nodes counted and, from their parents, of their siblings; stored."""
    told = lambda node, f, g, n: (node, f, g, n, *best_cut(g, n, least, l2))
    names = [x.split()[0] for x in HISTOGRAMS.split(", ")]
    total = lambda rows, c: np.sum(np.stack(rows[c].to_numpy()), axis=0)

    def alone(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([told(own["node"].iloc[0], own["feature"].iloc[0], total(own, "g"), total(own, "n"))], columns=names)

    def both(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(above):
            return pd.DataFrame(columns=names)
        node, f, g, n = own["node"].iloc[0], own["feature"].iloc[0], total(own, "g"), total(own, "n")
        return pd.DataFrame([told(node, f, g, n), told(node ^ 1, f, np.asarray(above["g"].iloc[0]) - g, np.asarray(above["n"].iloc[0]) - n)], columns=names)

    if parents is None:
        return settled(parts.groupBy("node", "feature").applyInPandas(alone, HISTOGRAMS))
    keyed = parts.withColumn("parent", F.shiftright("node", 1))
    above = parents.select(F.col("node").alias("parent"), "feature", "g", "n")
    return settled(keyed.groupBy("parent", "feature").cogroup(above.groupBy("parent", "feature")).applyInPandas(both, HISTOGRAMS))


def chosen(known: dict[int, tuple], expanded: set[int], leaves: int) -> tuple[set[int], int | None]:
    """Nodes that best-first growth splits, in the tree known so far, and the node it waits for, if any."""
    own, ends = set(), {1}
    while len(ends) < leaves:
        top = max(ends, key=lambda i: (known[i][0], -i))
        if known[top][0] <= 0:
            break
        if top not in expanded:
            return own, top
        own.add(top)
        ends = ends - {top} | {2 * top, 2 * top + 1}
    return own, None


def grow(rows: DataFrame, forest: Forest, since: int, p: dict) -> Tree:
    """One tree, best-first; known: node to (gain, feature, cut, missing_left, gradients, rows)."""
    known: dict[int, tuple] = {}
    expanded: set[int] = set()
    store: DataFrame | None = None
    while True:
        if not known:
            fresh = histograms(counted(rows, forest, since, Tree({}), [1]), None, p["least"], p["l2"])
        else:
            split, waits = chosen(known, expanded, p["leaves"])
            if waits is None:
                break
            open_ = sorted((i for i in known if i not in expanded and known[i][0] > 0), key=lambda i: (-known[i][0], i))
            take = dict.fromkeys([waits, *open_[: max(1, p["leaves"] - 1 - len(split))]])
            expanded |= set(take)
            tentative = Tree({i: known[i][1:4] for i in expanded})
            small = [2 * i if known[i][6] * 2 <= known[i][5] else 2 * i + 1 for i in take]
            fresh = histograms(counted(rows, forest, since, tentative, small), store.where(F.col("node").isin(list(take))), p["least"], p["l2"])
        store = fresh if store is None else store.unionByName(fresh)
        # The best cut of each node, ties to the first feature; its rows on the left tell the smaller child.
        total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
        sums = F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x)
        left = F.aggregate(F.slice("n", 1, F.col("cut") + 1), F.lit(0).cast("long"), lambda a, x: a + x) + F.when(F.col("missing_left"), F.element_at("n", MISSING + 1)).otherwise(0)
        told = F.struct(F.col("gain"), (-F.col("feature")).alias("f"), "cut", "missing_left", sums.alias("g"), total.alias("n"), F.when(F.col("gain") > 0, left).otherwise(0).alias("left"))
        for r in fresh.groupBy("node").agg(F.max(told).alias("b")).collect():  # a row a node
            b = r["b"]
            deep = int(r["node"]).bit_length() > p["depth"]
            known[r["node"]] = (0.0 if deep else b["gain"], -b["f"], b["cut"], b["missing_left"], b["g"], b["n"], b["left"])
        if 1 not in known:
            raise ValueError("no rows to train on")
    split, _ = chosen(known, expanded, p["leaves"])
    ends = {1} | {c for i in split for c in (2 * i, 2 * i + 1)}
    values = {i: -p["rate"] * (known[i][4] / FIXED) / max(known[i][5] + p["l2"], 1e-300) for i in ends - split}
    return Tree({i: known[i][1:4] for i in split}, values)


def fit(df: DataFrame, names: list[str], label: str = "spei", edges: list[np.ndarray] | None = None, **params) -> Forest:
    """A forest of leaf-wise trees for squared error. Rows without a label are left out; a table without any is an error.

    Missing and non-finite features go to the side of each cut that gains more. edges: bins of the
    features, if they are known.
    """
    p = PARAMS | params
    unknown = set(p) - set(PARAMS)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    edges = edges or edges_of(df, names)
    rows = prepared(df, names, edges, label)
    first = rows.agg(F.avg("y")).first()[0]
    if first is None:
        raise ValueError("no rows to train on")
    forest, since = Forest(names, edges, float(first), []), 0
    held = rows.withColumn("pred", F.lit(forest.first))
    for k in range(p["trees"]):
        forest.trees.append(grow(held, forest, since, p))
        if (k + 1) % REFRESH == 0 and k + 1 < p["trees"]:
            held, since = settled(_moved(held, forest, since)), k + 1
    return forest


def _moved(rows: DataFrame, forest: Forest, since: int) -> DataFrame:
    fresh, features = forest.trees[since:], len(forest.names)

    def run(batches):
        for batch in batches:
            x, pred = bins_of(batch.column(0), features), np.asarray(batch.column(2)).copy()
            for t in fresh:
                pred += t.value[t.place(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred)], names=["x", "y", "pred"])

    return rows.mapInArrow(run, "x binary, y double, pred double")
