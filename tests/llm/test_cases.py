"""Odd rows for every operator and stage: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from drywell.llm import common, fingerprint, media, mixing, packing, quality, repair, simhash, tokens, toxicity, warc, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, row_id long, size long, _keep int, _row int, component_id long, copies long, digest string, length int"
LONG = "word and more words than one sequence holds " * 900
PROSE = "The river rose in spring. It fell again by summer, and nobody minded.\nThe second line says something else."


def rows():
    texts = [PROSE, None, "", " \n\t", LONG, PROSE, "ZÜRICH löst Äpfel", "1", PROSE, "x"]
    ids = [5, 7, 3, 9, 11, 5, None, 2, 5, None]
    sources = ["b", None, "a", "é", "b", "b", None, "a", "b", "Z"]
    return [(i, t, None, s, None, 1.0, "f", 1, 2, 3, 4, 5, 6, "d", 7) for i, t, s in zip(ids, texts, sources)]


@pytest.fixture(scope="module")
def odd(spark):
    common.prepare(spark)
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encode():
    t = tokens.encoder(tokens.tokenizer_path())
    return lambda text: t.whole.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_repair(spark, odd, none, encode):
    got = repair.read_shards(repair.write_shards(odd, common.fresh(spark, "t"), tokens.tokenizer_path(), shard_ids=50)).collect()
    hashed = lambda t: None if t is None else int.from_bytes(xxhash.xxh64_intdigest(t.encode(), 42).to_bytes(8, "big"), "big", signed=True)
    want = sorted(((r[0] is not None, r[0] or 0), hashed(r[1]) if r[1] is not None else 42, r[1] or "") for r in rows())
    at, expected = 0, []
    for (_, i), _, text in want:
        ids = encode(text) + [1]
        expected.append((at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    assert sum(r["doc_id"] is None for r in got) == 2
    assert repair.read_shards(repair.write_shards(none, common.fresh(spark, "t"), tokens.tokenizer_path())).count() == 0


def test_wordpiece(odd, none):
    path = tokens.tokenizer_path(wordpiece.VOCABULARY)
    got = wordpiece.count_tokens(odd, path).collect()
    assert len(got) == 10 and sum(r["n_tokens"] == 0 for r in got) == 3
    assert {r["n_words"] for r in got if r["doc_id"] == 11} == {len(LONG.split())}
    assert wordpiece.count_tokens(none, path).count() == 0


def test_mixing(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == 10
    for r in got:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] and (r["size"] or not r["taken"])
    assert mixing.mix(none).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(odd).collect()))
    kept = mixing.repeat_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["copies"] for r in got)
    assert mixing.repeat_documents(none).count() == 0


def test_warc(spark, odd, none):
    pages = odd.selectExpr("doc_id AS page_id", "source AS url", "text AS html", "digest", "length AS offset", "'q' AS record_type", "row_id AS row")
    got = warc.read_packages(warc.write_packages(pages, common.fresh(spark, "t"), zip64=True)).collect()
    want = []
    for page, text in ((r[0], r[1]) for r in rows()):
        data = (text or "").encode()
        want.append((len(data), hashlib.sha256(data).hexdigest()))
    assert sorted((r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(want)
    prose = [r for r in got if r["payload_digest"] == hashlib.sha256(PROSE.encode()).hexdigest()]
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in prose) == [("response", 0), ("revisit", 5), ("revisit", 5)]
    assert all(r["record_type"] == "response" for r in got if r["payload_bytes"] < 100)
    empty = none.selectExpr("doc_id AS page_id", "source AS url", "text AS html")
    assert warc.read_packages(warc.write_packages(empty, common.fresh(spark, "t"))).count() == 0


def test_packing(odd, none, encode):
    got = packing.pack_documents(odd, tokens.tokenizer_path()).collect()
    assert sum(r["length"] for r in got) == sum(len(encode(r[1])) + 1 for r in rows())
    assert sum(r["piece"] == 0 for r in got) == 10
    check_packed(got)
    assert packing.pack_documents(none, tokens.tokenizer_path()).count() == 0


def check_packed(got, capacity=2048):
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_quality(odd, none):
    fitted = quality.fit(odd)
    assert quality.score_quality(odd, fitted).count() == 10
    kept = quality.keep_good(odd, fitted)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 3
    empty = quality.fit(none)
    assert quality.score_quality(none, empty).count() == 0 and quality.keep_good(none, empty).count() == 0


def test_media(odd, none):
    got = media.document_media(odd).collect()
    want = []
    for text in (r[1] for r in rows()):
        data = (text or "").encode()
        p = data + b" " * (-len(data) % 192 if data else 192)
        want.append((len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] == 5}) == 1
    assert media.document_media(none).count() == 0


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(5, None, 1), (7, 1, None), (None, 1, 0), (3, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        fitted = toxicity.fit(odd, given)
        got = toxicity.score_toxicity(odd, fitted).collect()
        assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
        kept = toxicity.drop_toxic(odd, fitted)
        assert kept.columns == odd.columns and kept.count() == 10
        assert toxicity.score_toxicity(none, fitted).count() == 0 and toxicity.drop_toxic(none, fitted).count() == 0
    assert toxicity.fit(none, labels)[0] == []


def test_fingerprint(odd, none):
    got = fingerprint.compare_versions(odd).collect()
    assert len(got) == 10 and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 5}) == 1
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 5)[-2:] == [1.0, 1.0]
    assert fingerprint.compare_versions(none).count() == 0
    only = fingerprint.compare_versions(odd.where("doc_id = 2")).first()
    assert only["near_next"] == 1.0


def test_simhash(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 10
    zero = [r for r in got if r["fingerprint"] == "0" * 16]
    assert len(zero) == 3 and {r["component_id"] for r in zero} == {3}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.where("doc_id = 5").collect()] == [5]
    assert simhash.drop_near_duplicates(none).count() == 0
    # Rows 5 and 5 are copies; 3, 7 and 9 have no words; the two rows without an id differ.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 3), (False, 5), (False, 11), (True, 0), (True, 0)]


def test_simhash_rows_that_share_an_id_or_have_none(spark):
    a, b, c = PROSE, "Quite another text with words of its own that no one else has, all of it.", "A third one, unlike the others in each and every word that it is made of."
    docs = spark.createDataFrame([(None, a), (None, b), (None, c), (None, c)], "doc_id long, text string")
    assert sorted(r["text"] for r in simhash.drop_near_duplicates(docs).collect()) == sorted([a, b, c])
    docs = spark.createDataFrame([(3, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted(map(tuple, simhash.drop_near_duplicates(docs).collect())) == [(3, a), (5, b)]
