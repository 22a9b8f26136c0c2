"""Centroid clustering, alignment of two tokenizers and SentencePiece pieces against plain definitions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from drywell.llm import alignment, common, kdtree, pieces, segments, tokens

from .test_cases import LONG, PROSE, rows

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, v int"
PIECES = tokens.tokenizer_path(pieces.VOCABULARY)
FIRST = tokens.tokenizer_path(alignment.FIRST)
SIGNS = [*"ab cdéß ▁ 　\n\t\x00\x7f\x85\xa0你好😀’.,0123", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", " the", "  ", "   ", "'ll"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def plain_clusters(vectors, k, rounds, seed):
    """Rows (id, whole vector) to (id, cluster, distance, ...), every distance in Python's whole numbers."""
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), z) for z, c in enumerate(now))
    for _ in range(rounds):
        own = {}
        for _, v in vectors:
            own.setdefault(near(v)[1], []).append(v)
        for z, group in own.items():
            now[z] = [sum(x) // len(group) for x in zip(*group)]
    found = [(i, *near(v)[::-1]) for i, v in vectors]
    sums = Counter()
    for _, z, d in found:
        sums[z] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, z, d, sums[z], sum(sums.values()), sha[z]) for i, z, d in found), key=str)


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (6, 4))
    given = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, 0.2, 4)]) for i in range(400)]
    given += [(1000 + i, [0.5, -0.25, 1.0, 0.0]) for i in range(300)]  # a hot vector
    given += [(7, given[7][1]), (None, [0.0, 0.0, 0.0, 0.0]), (None, [0.125, 0.0, 0.0, -3.0])]
    odd = [(2001, None), (2002, [1.0, 2.0, 3.0]), (2003, [1.0, None, 2.0, 3.0]), (2004, [1.0, float("nan"), 0.0, 0.0]), (2005, [float("inf"), 0.0, 0.0, 0.0]), (2006, [0.0, 0.0, float("-inf"), 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in given + odd], SCHEMA).repartition(5)
    for k, rounds in ((12, 5), (2000, 1)):  # more centroids than vectors: as many as there are
        got = sorted((tuple(r) for r in kdtree.cluster(df, dims=4, centroids=k, rounds=rounds).collect()), key=str)
        assert got == plain_clusters([(i, [int(np.floor(256 * x)) for x in v]) for i, v in given], k, rounds, 2)
    assert kdtree.cluster(df.limit(0), dims=4).count() == 0
    assert kdtree.cluster(df, dims=5).count() == 0
    with pytest.raises(Exception, match="no long holds"):
        kdtree.cluster(spark.createDataFrame([(1, [3e9] * 4, 1, 2, 3, 4)], SCHEMA), dims=4)


@pytest.mark.parametrize("most", [3, 1 << 26])
def test_trees_are_exact_with_ties_and_large_components(most):
    rng = np.random.default_rng(most)
    for n in (1, 33, 700):
        points = rng.integers(-most, most + 1, (n, 3))
        centroids = np.concatenate([rng.integers(-most, most + 1, (9, 3)), points[:2], points[:2]])
        tree, order = kdtree.Tree.grown(points)
        assert sorted(order.tolist()) == list(range(n)) and (tree.points == points[order]).all()
        tree = kdtree.Tree.read(*tree.stored(), 3)
        counts, sums, label, distance = tree.nearest(centroids, True)
        far = ((tree.points[:, None] - centroids[None]) ** 2).sum(2)
        assert (label == far.argmin(1)).all() and (distance == far.min(1)).all()
        for z in range(len(centroids)):
            assert counts[z] == (label == z).sum() and (sums[z] == tree.points[label == z].sum(0)).all()


def test_whole_nodes_are_taken_and_centroids_pruned():
    """Of far-apart groups hardly a vector reaches a leaf: their nodes are counted whole."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 20, (500, 8)) + 10_000 * g for g in range(4)])
    tree, _ = kdtree.Tree.grown(points)
    counts, _, label, _ = tree.nearest(np.array([[10_000 * g] * 8 for g in range(4)]), False)
    assert counts.tolist() == [500] * 4 and (label == -1).mean() > 0.9


def test_pieces_equal_the_library():
    own = pieces.vocabulary(PIECES)
    texts = [None, "", " ", "  ", "▁", "a▁ b", "ab" * 5000, PROSE, LONG, *random_texts(3000, 4)]
    ids, ends = own.encode(pa.array(texts, pa.string()))
    for a, b, text in zip([0, *ends[:-1]], ends, texts):
        want = own.library.encode(text or "")
        assert ids[a:b].tolist() == want
        assert own.decode(want) == own.library.decode(want)
        assert own.merged(own.prepared(text or "")) == want
    rng = random.Random(9)
    for _ in range(3000):  # ids that no text gives: bytes that make no sign, control pieces between
        x = [rng.choice([rng.randrange(32_000), rng.randrange(260)]) for _ in range(rng.randint(0, 10))]
        assert own.decode(x) == own.library.decode(x)


def test_pieces_without_cuts_and_with_other_kinds():
    own = pieces.Vocabulary(PIECES)
    own.apart = False
    texts = random_texts(200, 6)
    ids, ends = own.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == own.library.encode(texts)
    # A made-up vocabulary: "abc" is unused and falls into its halves, "<x>" is never merged, "ß" has no piece and no bytes.
    own.merges = {p: (-s, i, u) for i, (p, s, u) in enumerate([("a", 0, False), ("b", 0, False), ("c", 0, False), ("ab", -1, False), ("abc", -2, True), ("<x>", 0, False), ("<", 0, False), ("c<", -1, False)])}
    own.frozen, own.bytes, own.unknown = pieces.re.compile("<x>"), {}, 99
    assert own.merged("abc<x>") == [3, 2, 5] and own.merged("c<") == [7] and own.merged("aßßb") == [0, 99, 1]


def test_pieces_that_differ_are_an_error(monkeypatch):
    own = pieces.Vocabulary(PIECES)
    monkeypatch.setattr(own, "steps", lambda sym, lens: [b"\0" * 4] * len(lens))
    with pytest.raises(ValueError, match="library's ids"):
        own.encode(pa.array(["some text"]))


def test_encode_pieces_of_odd_rows(spark):
    common.prepare(spark)
    odd = spark.createDataFrame([(r[0], r[1], 1, "x") for r in rows()], "doc_id long, text string, n_tokens long, ids_sha256 string")
    library = pieces.vocabulary(PIECES).library

    def want(text):
        ids = library.encode(text or "", add_eos=True)
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    for whole in (False, True):
        got = sorted((tuple(r) for r in pieces.encode_pieces(odd, PIECES, whole=whole).collect()), key=str)
        assert got == sorted(((r[0], *want(r[1])) for r in rows()), key=str)
    assert pieces.encode_pieces(odd.limit(0), PIECES).count() == 0


def test_cuts_are_before_spaces_behind_visible_signs():
    texts = pa.array(["a b  c", "", None, " x  y　 z", "end ", "▁ a"])
    names, index, ends = segments.cut(segments.spaced(texts))
    parts = [names[i] for i in index]
    assert [parts[a:b] for a, b in zip([0, *ends[:-1]], ends)] == [[" a", " b", "  c"], [], [], ["  x  y　 z"], [" end", " "], [" ▁ a"]]


def plain_alignment(texts):
    """By whole texts, common ends as sets, pairs in nested loops."""
    own = alignment.aligner(FIRST, PIECES)
    per, held = [], Counter()
    for text in texts:
        a = own.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = own.b.library.encode(text or "")
        x, y = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            per.append(None)
            continue
        ends_a, ends_b = np.cumsum(list(map(len, x))).tolist(), np.cumsum(list(map(len, y))).tolist()
        groups, p = [], 0
        for e in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, q in zip(a, ends_a) if p < q <= e], [j for j, q in zip(b, ends_b) if p < q <= e]))
            p = e
        links = Counter((i, j) for u, v in groups for i in u for j in v)
        held.update(links.keys())
        sha = hashlib.sha256(";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in groups).encode()).hexdigest()
        per.append((len(a), len(b), len(groups), links, sha))
    best_a, best_b = Counter(), Counter()
    for (i, j), n in held.items():
        best_a[i], best_b[j] = max(best_a[i], n), max(best_b[j], n)
    out = []
    for x in per:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, "", 0))
        else:
            links = x[3]
            out.append((*x[:3], sum(links.values()), sum(n for (i, j), n in links.items() if held[i, j] == best_a[i]), sum(n * held[k] for k, n in links.items()), x[4], sum(n for (i, j), n in links.items() if held[i, j] == best_b[j])))
    return out


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20])
def test_alignment_equals_plain_links(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)  # few frequent pairs: both joins have rows
    texts = [r[1] for r in rows()] + random_texts(300, 8) + ["don't \t stop<|endoftext|> now", "Grüße aus Köln, 12½ km", "a▁b"]
    ids = [r[0] for r in rows()] + [(1 << 60) + k for k in range(303)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts)], "doc_id long, text string, pair long, groups_sha256 string").repartition(3)
    got = alignment.align(docs, FIRST, PIECES).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *x) for i, x in zip(ids, plain_alignment(texts))), key=str)
    assert alignment.align(docs.limit(0), FIRST, PIECES).count() == 0


def test_large_groups_and_a_full_memo(monkeypatch):
    texts = pa.array([*random_texts(200, 3), "ab" * 500 + " ab", PROSE])
    own = alignment.Aligner(FIRST, PIECES)
    want = own.rows(texts)
    monkeypatch.setattr(alignment, "LARGE", 1)
    monkeypatch.setattr(alignment, "MEMO", 3)
    own.forget()
    for a, b in ((0, 100), (100, 202)):
        for x, y in zip(want[a:b], own.rows(texts.slice(a, b - a))):
            assert x[:5] == y[:5] and list(x[5]) == list(y[5]) and list(x[6]) == list(y[6])


def test_alignment_without_cuts():
    own = alignment.Aligner(FIRST, PIECES)
    texts = pa.array(["", None, *random_texts(100, 2), PROSE])
    cut = own.rows(texts)
    own.cuts = False
    own.forget()
    for x, y in zip(cut, own.rows(texts)):
        assert x[:5] == y[:5] and list(x[5]) == list(y[5]) and list(x[6]) == list(y[6])
    with pytest.raises(ValueError):
        alignment.Aligner(tokens.tokenizer_path(), PIECES)
