"""Operators against plain definitions, exact round trips and held-out labels."""

import hashlib
import io
import os
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from drywell.llm import common, fingerprint, media, mixing, packing, quality, registry, repair, simhash, tokens, toxicity, warc, wordpiece

from .test_cases import check_packed, crc

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


@pytest.fixture(scope="module")
def docs(spark):
    common.prepare(spark)
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def encode():
    t = tokens.encoder(tokens.tokenizer_path())
    return lambda text: t.whole.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_whole_texts(encode):
    texts = ["", None, " a  b ", "it's 'S the'LL <|endoftext|>x a_b 12½ é́ Straße İ ß ÀÉ x\x1cy\x85z ﬁ ÆŒœ Ünï, über... ǅ 你好 '", "\x0b\x0c x\x0by\ta\r\n", "THE.!! it%%% A`s` 12x3 ÀÉß.ÖÄ,x\x00\x7f ~", "<|startoftext|>", "ſt ʼs ª µ"]
    rng = random.Random(3)
    texts += ["".join(rng.choice("ab ABéß.,'!?9_\n\té́Σσς<|>") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    ids, ends = tokens.encoder(tokens.tokenizer_path()).encode(pa.array(texts, pa.string()))
    for a, b, text in zip([0, *ends[:-1]], ends, texts):
        assert ids[a:b].tolist() == encode(text)


@data
def test_op1(spark, docs, encode):
    got = {r["doc_id"]: r for r in registry.QUERIES["op1_repair_tokens"](spark, SMALL).collect()}
    at = 0
    for i, text in docs:
        ids = encode(text) + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(got) == len(docs)


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(7)
    words = [rng.integers(2, 49_408, rng.integers(1, 6)) for _ in range(60)]
    own = [np.concatenate([*(words[k] for k in rng.integers(0, 60, rng.integers(0, 300))), [1]]).astype(np.uint16) for _ in range(80)]
    own += [np.array([5] * 999 + [1], np.uint16), np.array([1], np.uint16), np.array([7, 1, 7, 1], np.uint16)]
    data_ = repair.pack_shard(list(range(len(own))), [len(x) for x in own], np.concatenate(own))
    shard = repair.Shard(data_)
    ids, ends = shard.everything()
    assert (ids == np.concatenate(own)).all() and len(shard.left) > 20 and len(shard.symbols) < len(ids) / 2
    for k, x in enumerate(own):
        assert shard.ids(k) == x.tolist() and shard.ids(k, 3, 40) == x[3:40].tolist()
    assert (shard.lengths >= 2).all()
    for k in range(0, 900, 37):
        assert shard.ids(80, k, k + 5) == own[80][k : k + 5].tolist()
    # Only a pair that occurs once is left between ends.
    seq = shard.symbols.astype(np.int64)
    pairs = [(a, b) for a, b in zip(seq[:-1].tolist(), seq[1:].tolist()) if 1 not in (a, b)]
    pairs = [p for p, q in zip(pairs, [None, *pairs]) if p != q]  # three like symbols are one pair
    assert len(pairs) == len(set(pairs))
    with pytest.raises(ValueError):
        repair.pack_shard([0], [2], np.array([50_000, 1], np.uint32))
    with pytest.raises(ValueError):
        repair.Shard(data_[:-9] + bytes([data_[-9] ^ 1]) + data_[-8:])


def test_other_tokenizers_and_wide_ids(spark):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    whole = tokens.Encoder(path)
    texts = ["It's a test, of 12 things.", "", None, "a  b\n\nc é 你好"]
    ids, ends = whole.encode(pa.array(texts, pa.string()))
    want = [whole.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)] == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = repair.read_shards(repair.write_shards(docs, common.fresh(spark, "t"), path, end=50_256)).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in got} == {k: crc([*x, 50_256]) for k, x in enumerate(want)}
    wide = np.array([3_000_000, 2_999_999, 3_000_000, 2_999_999, 7], np.uint32)
    shard = repair.Shard(repair.pack_shard([1], [5], wide, 7, 3_000_001))
    assert len(shard.symbols) == 3 and shard.everything()[0].tolist() == wide.tolist()


@data
def test_op2(spark, docs):
    pieces = set(wordpiece.load_pieces(tokens.tokenizer_path(wordpiece.VOCABULARY)))
    longest = max(map(len, pieces))
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_token_counts"](spark, SMALL).collect()}
    for i, text in docs[:60]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        assert (got[i]["n_words"], got[i]["n_tokens"]) == (len(words), sum(wordpiece.greedy_count(w, pieces, longest) for w in words))
    assert len(got) == len(docs)


def test_automaton_counts_greedily():
    rng = random.Random(11)
    for _ in range(60):
        pieces = {"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 25))}
        machine = wordpiece.Automaton(sorted(pieces))
        for _ in range(60):
            word = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 14)))
            assert machine.count(word) == wordpiece.greedy_count(word, pieces, 5)


@data
def test_op3(spark, docs):
    got = registry.QUERIES["op3_source_mixing"](spark, SMALL).collect()
    again = registry.QUERIES["op3_source_mixing"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sizes, target, taken = {}, {}, {}
    text = dict(docs)
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    want = filled(sizes)
    assert target == pytest.approx(want)
    for s in sizes:  # ten documents in each source
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 100


def filled(sizes, most=3):
    """Targets by plain rounds of sharing out."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, total, left = {}, sum(sizes.values()), set(names)
    while left:
        level = (total - sum(out.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in left}
        for s in over:
            out[s] = most * sizes[s]
            left.remove(s)
    return out


def test_targets_stop_at_three_times_the_source(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 3, None: 50}, {"a": 1, "b": 1, "c": 1000}, {"a": 100}, {"a": 0, "b": 7}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(rows).select("source", "source_size", "target").collect()}
        assert got == pytest.approx(filled(sizes))


def test_long_documents_are_likelier(spark):
    rows = [(i, "w " * (1 + i % 50), "s" if i % 2 else "t") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("target < source_size").collect()
    small, large = ([r["copies"] for r in got if (r["size"] <= 15) == small] for small in (True, False))
    assert np.mean(small) < np.mean(large)


@data
def test_op4(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = registry.QUERIES["op4_zip_warc"](spark, SMALL)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES['op4_zip_warc']})").fetchall())


def test_zip_files_are_read_by_others_and_of_others():
    members = [("archive/data.warc.gz", b"x" * 1000), ("indexes/é.cdxj", b"")]
    for wide in (False, True):
        blob = b"".join(warc.zip_bytes(members, wide))
        with zipfile.ZipFile(io.BytesIO(blob)) as z:
            assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
        mine = warc.ZipReader(lambda n, at: blob[at : at + n], len(blob))
        for name, body in members:
            start, length = mine.locate(name)
            assert blob[start : start + length] == body
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", b"stored")
        z.writestr("b", b"deflated" * 99, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\5\6 that looks like an end"
    blob = buffer.getvalue()
    theirs = warc.ZipReader(lambda n, at: blob[at : at + n], len(blob))
    start, length = theirs.locate("a")
    assert blob[start : start + length] == b"stored"
    with pytest.raises(ValueError):
        theirs.locate("b")


def test_packages_keep_payloads(spark):
    html = ["<p>é\r\n\r\nx</p>" * 40, "", "ü"]
    pages = spark.createDataFrame([(k, f"http://h/{k}\r\n", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    path = warc.write_packages(pages.coalesce(1), common.fresh(spark, "w")).first()["path"]
    files, name = common.open_fs(path)
    with files.open_input_file(name) as f:
        got = list(warc.read_records(f, f.size(), most=1))
    assert [p.decode() for _, p in got] == html and [h["WARC-Target-URI"] for h, _ in got][0] == "http://h/0%0D%0A"


@data
def test_op5(spark, docs, encode):
    got = registry.QUERIES["op5_best_fit_packing"](spark, SMALL).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in docs:
        ids = encode(text) + [0]
        own = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 2048))
        for r in own:
            part = ids[r["start"] : r["start"] + 2048]
            assert (r["length"], r["ids_crc32"]) == (len(part), crc(part))
    assert check_packed(got) <= 1.02 * -(-sum(r["length"] for r in got) // 2048) + 1


def test_plans_place_every_item_and_stay_near_the_bound():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([7, 20, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(0, 12))}
        patterns = packing.plan(counts, capacity)
        placed = {}
        for n, content in patterns:
            assert n > 0 and sum(s * k for s, k in content) <= capacity and sum(k for s, k in content if 3 * s > capacity) <= 2
            for s, k in content:
                placed[s] = placed.get(s, 0) + n * k
        assert placed == counts
        bins, total = sum(n for n, _ in patterns), sum(s * n for s, n in counts.items())
        assert bins <= 1.5 * total / capacity + 1 + sum(n for s, n in counts.items() if 2 * s > capacity)
        ranks = {}
        for s, first, n, *_ in packing.slots(patterns):
            assert first == ranks.get(s, 0)
            ranks[s] = first + n
        assert ranks == counts


@data
def test_op6(spark):
    got = registry.QUERIES["op6_quality_classifier"](spark, MIDDLE).collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    judged = [(label[r["doc_id"]], r["keep"]) for r in got if r["doc_id"] in label]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    assert sum(b for a, b in judged if a) >= 0.99 * sum(a for a, _ in judged)


def plain_quality(text, posterior, weights):
    """(posterior, score) of one text by plain loops over its words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    shapes = [re.sub(r"(.)\1+", r"\1", "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in w), flags=re.S) for w in words]
    share = lambda test: sum(map(test, range(n))) / max(1, n)
    stats = {
        "signs": share(lambda k: bool(quality.SIGNS.search(words[k]))), "capitals": share(lambda k: words[k].isupper() and len(words[k]) > 1), "repeats": share(lambda k: k > 0 and words[k] == words[k - 1]),
        "bars": share(lambda k: "|" in words[k]), "sameness": 1 - min(1, len(set(words)) / min(max(1, n), 6 * max(1, n) ** 0.5)), "top": max(map(words.count, set(words)), default=0) / max(1, n),
        "marks": share(lambda k: len(shapes[k]) > 1 and not shapes[k][-1].isalnum() and shapes[k][-1] not in ".,;:?"), "unlike": share(lambda k: shapes[k] not in ("a", "A", "Aa", "a.", "a,", "Aa.", "Aa,", "A.", "A,")),
    }
    votes = []
    for stat, bad in quality.FAULTS.items():
        votes.append(quality.BAD if stats[stat] >= bad and not (stat in ("repeats", "sameness", "top") and n < quality.LEAST_WORDS) else quality.NONE)
    votes += [quality.GOOD if all(stats[k] <= x for k, x in most.items()) else quality.NONE for most in quality.VIRTUES]
    pattern = sum(v * 3**k for k, v in enumerate(votes if n else [0] * len(votes)))
    at = lambda x: zlib.crc32(x.encode())
    groups = [
        [at("w " + w.lower()) for w in words], [at("s " + x) for x in shapes],
        [(at("s " + shapes[k]) * 31 + at("s " + shapes[k + 1])) * 2 + (words[k] == words[k + 1]) + 7 for k in range(n - 1)],
    ]
    total = weights[-1]
    for own in groups:
        dims = [x % (quality.DIMENSIONS - 1) for x in own]
        total += sum((dims.count(d) / len(dims)) ** 0.5 * weights[d] for d in set(dims))
    return posterior.get(pattern, 0.5), 1 / (1 + np.exp(-np.clip(total, -30, 30)))


@data
def test_op6_scores_are_those_of_brute_force(spark, docs):
    own = [t for _, t in docs[:90]] + [None, "", "a", "A A A a a a a a a a", "# $$ | |x| 12,5 Éé.", "x" * 5000]
    table = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    posterior, weights = quality.fit(table)
    for r in quality.score_quality(table, (posterior, weights)).collect():
        post, score = plain_quality(own[r["doc_id"]], posterior, weights)
        assert (r["posterior"], r["score"]) == pytest.approx((post, score)) and r["keep"] == (r["score"] >= quality.THRESHOLD)


def test_expectation_maximisation_is_that_of_plain_loops():
    patterns = {0: 3, 28_431: 50, 8_021: 9, 18: 4, 6_561: 2, 542: 5}
    got, table, share = quality.estimate(patterns)
    votes = {p: [p // 3**k % 3 for k in range(len(quality.LABELLERS))] for p in patterns}
    post = {p: (v.count(quality.GOOD) + 1.5) / (v.count(quality.GOOD) + 3 * v.count(quality.BAD) + 2) for p, v in votes.items()}
    for _ in range(200):
        good = (sum(n * post[p] for p, n in patterns.items()) + 8) / (sum(patterns.values()) + 10)
        said = {}
        for k in range(len(quality.LABELLERS)):
            for c in (0, 1):
                w = [1.0, 1.0 if c else 0.2, 0.2 if c else 1.0]
                for p, n in patterns.items():
                    w[votes[p][k]] += n * (post[p] if c else 1 - post[p])
                said[k, c] = [x / sum(w) for x in w]
        for p, v in votes.items():
            like = [np.prod([said[k, c][x] for k, x in enumerate(v)]) * (good if c else 1 - good) for c in (0, 1)]
            post[p] = like[1] / sum(like)
    assert got == pytest.approx(post, abs=1e-6) and share == pytest.approx(good, abs=1e-6)


def test_the_fit_reads_a_bounded_sample_of_distinct_texts(spark):
    texts = spark.range(40_000).selectExpr("CASE WHEN id % 2 = 0 THEN '' WHEN id % 3 = 0 THEN 'one text' ELSE concat('text ', id) END AS text")
    got = quality.sample(texts, 500).collect()
    assert len(got) == 500 and len({r["text"] for r in got}) == 500
    assert quality.sample(texts.where("text = ''"), 500).count() == 1 and quality.sample(texts.limit(0), 500).count() == 0
    model = quality.fit(texts.where("text = ''").selectExpr("cast(null as string) AS text", "1L AS doc_id"))
    assert quality.score_quality(texts.selectExpr("1L AS doc_id", "text").limit(3), model).count() == 3


def test_labellers_accuracies_are_found():
    rng = np.random.default_rng(2)
    m, n = len(quality.LABELLERS), 20_000
    good = rng.random(n) < 0.8
    votes = np.zeros((n, m), np.int64)
    for k in range(m):
        if k < len(quality.FAULTS):
            votes[:, k] = np.where(rng.random(n) < np.where(good, 0.02, 0.4), quality.BAD, quality.NONE)
        else:
            votes[:, k] = np.where(rng.random(n) < np.where(good, 0.9, 0.1), quality.GOOD, quality.NONE)
    keys, counts = np.unique(quality.pattern_of(votes), return_counts=True)
    posterior, table, share = quality.estimate(dict(zip(keys.tolist(), counts.tolist())))
    assert share == pytest.approx(0.8, abs=0.03)
    assert table[0, 0, quality.BAD] == pytest.approx(0.4, abs=0.05) and table[-1, 1, quality.GOOD] == pytest.approx(0.9, abs=0.03)
    said = np.array([posterior[p] for p in quality.pattern_of(votes).tolist()])
    assert ((said >= 0.5) == good).mean() > 0.95


@data
def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_media_columns"](spark, SMALL).collect()}
    for i, text in docs:
        b = text.encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        stored = media.to_png(p, len(b))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(p)) and (r["position"], r["caption"], r["n_elements"]) == (1, f"text of document {i}", 2)
    assert len(got) == len(docs)


def test_interleaving_keeps_order_and_captions():
    html = '<html><head><title>T</title><style>x{}</style></head><p>a &amp; b<img src="u1" alt="q">c<script>if(1<2)</script></p><figure><img src=u2><img src=u3 alt=z><figcaption>cap <b>x</b></figcaption></figure>tail<img alt="no source">'
    assert media.interleave(html) == [
        (0, "text", "T", None, None), (1, "text", "a & b", None, None), (2, "media", None, "u1", "q"), (3, "text", "c", None, None), (4, "media", None, "u2", "cap x"), (5, "media", None, "u3", "cap x"), (6, "text", "tail", None, None),
    ]
    assert media.interleave(None) == [] and media.interleave("<p>") == []


def test_captions_before_unclosed_and_nested():
    kinds = lambda html: [(x[1], x[2] or x[3], x[4]) for x in media.interleave(html)]
    assert kinds("<figure><figcaption>cap</figcaption><img src=a></figure>x") == [("media", "a", "cap"), ("text", "x", None)]
    assert kinds("<figure><img src=a><figcaption>cap</figure><p>rest of it</p><p>more</p>") == [("media", "a", "cap"), ("text", "rest of it", None), ("text", "more", None)]
    assert kinds("<figure><img src=a><figcaption>cap<h2>head</h2><p>rest</p>") == [("media", "a", "cap"), ("text", "head", None), ("text", "rest", None)]
    assert kinds("<figcaption>no figure</figcaption><img src=a alt=b>") == [("text", "no figure", None), ("media", "a", "b")]
    assert kinds("<figure><figure><img src=a><figcaption>in</figcaption></figure><img src=b><figcaption>out <p>x</p></figcaption></figure>") == [("media", "a", "in"), ("media", "b", "out x")]
    assert kinds("<figure><img src=a><figcaption>one <b>two</b><script>no</script></figcaption></figure>") == [("media", "a", "one two")]


@data
def test_pages_interleaved(spark):
    got = {r["page_id"]: r for r in registry.QUERIES["pages_interleaved"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        own = media.interleave(r["html"])
        lines = "\n".join("\t".join([str(x[0]), x[1], x[2] or "", x[3] or "", x[4] or ""]) for x in own)
        assert got[r["page_id"]]["sequence_sha256"] == hashlib.sha256(lines.encode()).hexdigest() and got[r["page_id"]]["n_text"] == len(own)


def test_pages_are_arrays_of_structs(spark):
    key = media.reference(media.padded(b"abc"), 3)
    html = f'<p>x</p><figure><figcaption>c</figcaption><img src="{media.SCHEME}{key}"></figure><p>y</p><img src="{media.SCHEME}{key}" alt="again"><img src="http://h/y.png">'
    pages = spark.createDataFrame([(1, html), (None, None), (1, html), (2, "")], "doc_id long, html string")
    stored = media.store_media(spark.createDataFrame([("abc",), ("abc",), ("d",)], "text string"), "text")
    rows = media.interleaved(pages, stored).collect()
    assert sorted(len(r["elements"]) for r in rows) == [0, 0, 5, 5]
    for r in rows:
        if r["elements"]:
            assert [(x["position"], x["kind"], x["caption"], x["n_bytes"]) for x in r["elements"]] == [(0, "text", None, None), (1, "media", "c", 3), (2, "text", None, None), (3, "media", "again", 3), (4, "media", None, None)]


def test_references_resolve_by_digest(spark):
    key = media.reference(media.padded(b"abc"), 3)
    pages = spark.createDataFrame([(1, f'<p>x</p><img src="{media.SCHEME}{key}" alt="one"><img src="http://h/y.png">')], "doc_id long, html string")
    features = media.media_features(media.store_media(spark.createDataFrame([("abc",)], "text string"), "text"))
    rows = sorted(media.resolve(media.sequences(pages, "doc_id", "html"), features).collect(), key=lambda r: r["position"])
    assert [(r["kind"], r["caption"], r["n_bytes"]) for r in rows] == [("text", None, None), ("media", "one", 3), ("media", None, None)]


@data
def test_op8(spark):
    got = registry.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").collect()
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(label[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in label]
    hit = sum(a and b for a, b in held)
    assert hit >= 0.85 * sum(a for a, _ in held) and hit >= 0.85 * sum(b for _, b in held)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_agrees_with_edit_distance():
    rng = random.Random(4)
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("vequ", True), ("lostrax", True), ("abcabcabcab", True)]
    lexicon = toxicity.Lexicon(terms)
    words = [t for t, _ in terms]
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "x", "t"])
        w = "".join(w) + rng.choice(["", "", "en", "iq"])
        best = None
        for term, stem in terms:
            heads = [w[:k] for k in range(len(w) + 1)] if stem else [w]
            d = min(distance(term, h) for h in heads)
            if d <= toxicity.edits(len(term), stem):
                best = d if best is None else min(best, d)
        found = lexicon.match(w)
        assert (found and found[1]) == best, w


def plain_score(text, terms, seen, weights):
    """The score of one text by all edit distances and plain loops over its words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    cores = [w.strip(toxicity.STRIP).lower() for w in words]
    x = [0.0, 0.0, 0.0]
    for p, core in enumerate(cores):
        fits = []
        for term, stem in terms:
            d = min(distance(term, core[:k]) for k in range(len(core) + 1)) if stem else distance(term, core)
            if d <= toxicity.edits(len(term), stem):
                fits.append(d)
        if not core or not fits:
            continue
        before, after = range(max(0, p - toxicity.WINDOW), p + 1), range(p, min(len(words), p + toxicity.WINDOW + 1))
        marked = any(words[k][0] in toxicity.MARKS for k in before) and any(words[k][-1] in toxicity.MARKS for k in after)
        quoted = marked or any(cores[k] in toxicity.REPORTING for k in before)
        if min(fits):
            x[2] += seen.get(core, 0.6) * (0.5 if quoted else 1)
        else:
            x[1 if quoted else 0] += 1
    x = [*np.log2(1 + np.array(x)), sum(x) / max(1, len(words)) ** 0.5, 1]
    return 1 / (1 + np.exp(-np.clip(np.dot(x, weights), -30, 30)))


@data
def test_op8_scores_are_those_of_brute_force(spark, docs):
    rng = random.Random(5)
    terms = [("idiot", False), ("worthless", False), ("scum", False), ("vequeon", True), ("mo", False)]
    weights = np.array([2.0, 0.4, 1.1, 0.7, -2.0])
    own = [t for _, t in docs[:40]]
    for _ in range(60):  # terms, whole, misspelled and quoted, among the words of the table
        words = rng.choice(own).split()[:60]
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(["idiot", "idi0t", "Worthless!", "worthles", "w0rthles", "scum", "vequeonaux", "vequonaux", "mo", '"idiot"', "said", "“scum”", "(scum)"])
            words.insert(rng.randrange(len(words) + 1), w)
        own.append(rng.choice([" ", "\n", "\u00a0 "]).join(words))
    own += ["", None, '"', "idiot"]
    table = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    seen = {"idi0t": 0.9, "worthles": 0.1}
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(table, (terms, seen, weights)).collect()}
    for k, text in enumerate(own):
        assert got[k] == pytest.approx(plain_score(text, terms, seen, weights)), text


def test_all_terms_beyond_chance_are_kept_and_split_as_they_are_scored(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(4))
    bad, fine = [word() for _ in range(650)], [word() for _ in range(300)]
    rows = []
    for k in range(6500):  # each bad word in about sixteen toxic rows, beside a no-break space
        toxic = int(k % 10 == 0)
        words = [rng.choice(fine) for _ in range(20)]
        if toxic:
            words += [x for w in rng.sample(bad, 16) for x in (f"\u00a0{w}", rng.choice(fine))]
        rows.append((k, " ".join(words), toxic))
    table = common.written(spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("text", "toxic"), "t")
    found = toxicity.learn_terms(table)
    lexicon = toxicity.Lexicon(found)
    assert sum((m := lexicon.match(f"\u00a0{w}")) is not None and m[1] == 0 for w in bad) > 600 and not any((m := lexicon.match(w)) is not None and m[1] == 0 for w in fine)
    x = toxicity.features(pa.array([rows[0][1], rows[1][1]]), lexicon, {})
    assert x[0, 0] > 2 and x[1, 0] == 0


def test_documents_that_repeat_an_id_count_once_in_the_fit(spark):
    docs = spark.createDataFrame([(k % 5, f"text {k}") for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(5)], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, "doc_id", "text").count() == sum(zlib.crc32(str(k).encode()) % 4 != 2 for k in range(5))


def test_quotation_lowers_a_score():
    lexicon = toxicity.Lexicon([("moron", False)])
    texts = pa.array(["you are a moron and a fool", 'he said "moron" to them again', "you are a mor0n and a fool", "all is well here", None])
    s = toxicity.score(toxicity.features(texts, lexicon, {}), toxicity.PRIOR)
    assert s[0] > s[1] > s[3] and s[0] > s[2] > s[3] and s[3] == s[4]


def paragraphs(text):
    """Runs of up to sixteen words within a sentence and a line, by plain loops."""
    out = set()
    for line in re.split(r"[\n\x0b\x0c\r]", text):
        run = []
        for word in re.findall(r"[^ \t]+", line):
            run.append(word)
            if len(run) == 16 or word[-1] in ".!?":
                out.add(tuple(run))
                run = []
        if run:
            out.add(tuple(run))
    return out


def alike(a, b):
    x, y = paragraphs(a), paragraphs(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


@data
def test_op9(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_iblt_fingerprints"](spark, SMALL).collect()}
    follows = {a[0]: b[1] for a, b in zip(docs, docs[1:] + docs[:1])}
    for i, text in docs:
        r, k = got[i], len(text) // 4
        edited = text[: len(text) - k] + follows[i][:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(alike(text, edited)) and r["near_next"] == pytest.approx(alike(text, follows[i]))
        own, new = paragraphs(text), paragraphs(edited)
        assert (r["paragraphs_left"], r["paragraphs_new"]) == (len(own - new), len(new - own))
    assert len({r["fingerprint"] for r in got.values()}) == len({t for _, t in docs})


def test_one_unit_whatever_the_size(spark):
    texts = ["Short one. And two here. Then three.", "Short one. And two here. Then three. Four is long enough to pass a hundred signs, which this does.", "a b c d", ""]
    texts += ["line %d of many" % k for k in range(1)] + ["\n".join(f"line {k} of this text" for k in range(100_000)), "one " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.compare_versions(docs).collect()}
    assert got[0]["near_next"] == pytest.approx(6 / 7)
    for i, (text, after) in enumerate(zip(texts, texts[1:] + texts[:1])):
        k = len(text) // 4
        assert got[i]["near_edited"] == pytest.approx(alike(text, text[: len(text) - k] + after[:k])) and got[i]["near_next"] == pytest.approx(alike(text, after))


def test_peeling_recovers_differences_and_retries(spark):
    rows = [(0, list(range(50)), list(range(3, 52))), (1, list(range(300)), list(range(500, 900))), (2, [], []), (3, [1], []), (4, list(range(5000)), list(range(2, 4000)))]
    rows += [(k, [k * 7 + j for j in range(k % 9)], [k * 7 + j + k % 3 for j in range(k % 7)]) for k in range(5, 60)]
    rows = spark.createDataFrame(rows, "id int, a array<long>, b array<long>")
    rows = rows.selectExpr("id", "a", "b", f"{fingerprint.sketch('a')} AS sa", f"{fingerprint.sketch('b')} AS sb")
    for r in fingerprint.differences(rows, "d", "a", "b", "sa", "sb").collect():
        assert r["d"]["ok"] and sorted(r["d"]["added"]) == sorted(set(r["a"]) - set(r["b"])) and sorted(r["d"]["removed"]) == sorted(set(r["b"]) - set(r["a"]))


def test_next_rows_over_sparse_and_repeated_ids(spark):
    rng = random.Random(6)
    rows = [(rng.choice([k, k * k * k, 10**15 + k, -k]), f"t{k}") for k in range(500)] + [(None, "n1"), (None, "n2"), (7, "a"), (7, "a")]
    rows += [(77, f"same{k}") for k in range(300)] + [(None, f"none{k}") for k in range(300)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    signed = lambda t: int.from_bytes(xxhash.xxh64_intdigest(t, 42).to_bytes(8, "big"), "big", signed=True)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(r[1]), r[1]))
    want = sorted((str(a[0]), a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert sorted((str(r["doc_id"]), r["text"], r["next"]) for r in got) == want


@data
def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op10_simhash_near_dedup"](spark, SMALL).collect()}

    def print_of(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: print_of(t) for i, t in docs}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for i in prints:
        assert got[i]["fingerprint"] == f"{prints[i]:016x}" and got[i]["component_id"] == find(i)


def first_of_near_copies(texts):
    """Smallest ids of the groups that five-word shingles at Jaccard 0.8 link, by all pairs that share a shingle."""

    def shingles(text):
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    own = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in own.items():
        for x in s or [None]:
            holders.setdefault(x, []).append(i)
    for i, s in own.items():
        for j in {j for x in s or [None] for j in holders[x] if j < i}:
            if own[j] == s or len(s & own[j]) >= 0.8 * len(s | own[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in own}


@data
def test_near_copies_are_those_of_brute_force(spark):
    found = common.written(simhash.drop_near_duplicates(spark.read.parquet(f"{MIDDLE}/documents.parquet")), "t")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert {r["doc_id"] for r in found.collect()} == first_of_near_copies(texts)


def test_chains_of_near_copies_and_pairs_that_are_turned_down(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, n = {}, 0
    for _ in range(6):
        base = [word() for _ in range(120)]
        for step in range(12):  # one chain and one star; members far apart in the chain are no copies of each other
            texts[n] = " ".join(base)
            n += 1
            base = [*base]
            base[rng.randrange(120)] = word()
    for _ in range(3):
        base = [word() for _ in range(100)]
        for _ in range(25):
            own = [*base]
            for _ in range(rng.randint(1, 6)):
                own[rng.randrange(100)] = word()
            texts[n] = " ".join(own)
            n += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()} == first_of_near_copies(texts)


def test_groups_stay_whole_in_small_holds():
    rng = np.random.default_rng(0)
    block, value = np.sort(rng.integers(0, 3, 500)), rng.integers(0, 9, 500)
    order = np.lexsort((value, block))
    table = pa.table({"x": np.arange(500), "block": block[order], "value": value[order]})
    seen = []
    for b, (x,) in simhash.dealt_groups(table.to_batches(max_chunksize=7), 1, 20):
        groups = {(block[order][i], value[order][i]) for i in x}
        assert {g[0] for g in groups} == {b}
        seen.append((groups, len(x)))
    assert sum(n for _, n in seen) == 500 and len(seen) > 5
    assert sum(len(g) for g, _ in seen) == len(set(zip(block, value)))


def test_forests_span_and_are_least():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 40, (2, 300))
    a, b, d = a[a != b], b[a != b], rng.integers(0, 9, (a != b).sum())
    got = simhash.forest(40, a, b, d)
    start = np.arange(40)
    assert (simhash.merged(start.copy(), a[got], b[got]) == simhash.merged(start.copy(), a, b)).all()
    parent, least = np.arange(40), 0
    for k in np.argsort(d, kind="stable"):
        if parent[a[k]] != parent[b[k]]:
            least += d[k]
            parent[parent == parent[a[k]]] = parent[b[k]]
    assert d[got].sum() == least


def test_index_finds_all_links_of_random_and_chained_prints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, size=1500, dtype=np.uint64) * np.uint64(2)
    near = base[:500].copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    chain = [base[0]]
    for _ in range(600):  # a hub whose members lie two bits apart
        chain.append(chain[rng.integers(0, len(chain))] ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))))
    prints = np.unique(np.concatenate([base, near, np.array(chain, np.uint64)]))
    parent = np.arange(len(prints))
    d = np.bitwise_count(prints[:, None] ^ prints[None, :])
    want = simhash.merged(parent.copy(), *np.nonzero(d <= 2))
    found = [simhash.local_links(prints, shift, width) for shift, width in simhash.BLOCKS]
    a, b = (np.searchsorted(prints, np.concatenate([f[k] for f in found])) for k in (0, 1))
    assert (simhash.merged(parent.copy(), a, b) == want).all()
    links = simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"))
    roots = {r["node"]: r["root"] for r in common.connected_components(links).collect()}
    groups = {}
    for x, w in zip(prints.view(np.int64).tolist(), want.tolist()):
        groups.setdefault(w, []).append(x)
    for own in groups.values():
        assert {roots.get(x, x) for x in own} == {min(own) if len(own) > 1 else own[0]}


@data
def test_pipeline_stages_agree_with_their_operators(spark):
    import corpus_pipeline

    found = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    label = {r["doc_id"]: r for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    seen = [found.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, found = found, stage(spark, found, MIDDLE)
        found = common.written(found, "test-stage")
        if name != "best-fit packing":
            assert found.columns == before.columns
        seen.append(found.count())
        ids = {r["doc_id"] for r in found.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "quality classifier":
            clean = [i for i, r in label.items() if r["quality"] == 1 and r["toxic"] == 0]
            kept = {r["doc_id"] for r in before.select("doc_id").collect()}
            assert sum(i in ids for i in clean if i in kept) >= 0.98 * sum(i in kept for i in clean)
        if name == "SimHash near-dedup":
            assert ids == first_of_near_copies({r["doc_id"]: r["text"] for r in before.collect()}) and found.count() == len(ids)
    assert seen[1] < seen[0] and seen[2] < seen[1] and seen[3] < seen[2]
    check_packed(found.collect())
    assert corpus_pipeline.run(spark, MIDDLE).count() == seen[-1]
