"""Cases in which an operator once did less than the whole job."""

import numpy as np
import pytest

from drywell.llm import common, mixing, simhash


def test_documents_are_drawn_by_their_inclusion_odds(spark):
    common.prepare(spark)
    sizes = [3, 5, 8, 8, 11, 14, 17, 20, 24, 28, 33, 40, 47, 55, 64, 75, 90, 110, 140, 300] * 15
    rows = [(f"s{k:03d}", size) for k in range(40) for size in sizes]
    docs = spark.createDataFrame([(i, "w " * size, s) for i, (s, size) in enumerate(rows)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 3)).collect()
    # Every source wants half of its words besides whole copies. The factor of the sizes by bisection.
    low, high = 0.0, 1.0
    for _ in range(60):
        factor = (low + high) / 2
        low, high = (factor, high) if sum(min(1, factor * n) * n for n in sizes) < sum(sizes) / 2 else (low, factor)
    drawn = {}
    for r in got:
        drawn.setdefault(r["size"], []).append(r["copies"] - int(r["target"] // r["source_size"]))
    for size, own in drawn.items():
        assert set(own) <= {0, 1} and abs(np.mean(own) - min(1, factor * size)) < 0.09, size
    assert abs(np.mean([x for own in drawn.values() for x in own]) - np.mean([min(1, factor * n) for n in sizes])) < 0.02
    by = {}
    for r, (s, _) in zip(sorted(got, key=lambda r: r["doc_id"]), rows):
        by.setdefault(s, [r["target"], 0])[1] += r["taken"]
    assert max(abs(taken - target) / target for target, taken in by.values()) < 0.015


def test_rows_keep_their_copies_when_splits_change(spark, tmp_path):
    common.prepare(spark)
    rows = [(k % 50 if k % 3 else None, f"word{k % 90} " * (1 + k % 40), f"s{k % 4}", k) for k in range(900)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string, place long").repartition(8).write.parquet(path)
    before = mixing.mix

    def moved(*args, **kwargs):
        out = before(*args, **kwargs)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    try:
        mixing.mix = moved
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        got = [r["place"] for r in mixing.repeat_documents(spark.read.parquet(path)).collect()]
    finally:
        mixing.mix = before
        spark.conf.unset("spark.sql.files.minPartitionNum")
    words, size = {}, {}
    for k in got:
        words[k % 4] = words.get(k % 4, 0) + 1 + k % 40
    for k in range(900):
        size[k % 4] = size.get(k % 4, 0) + 1 + k % 40
    target = {int(r["source"][1:]): r["target"] for r in mixing.targets(spark.createDataFrame([(f"s{s}", n) for s, n in size.items()], "source string, source_size long")).collect()}
    assert all(abs(words[s] - target[s]) < 0.01 * target[s] + 20 for s in target)


def test_one_long_document_does_not_empty_the_mix(spark):
    common.prepare(spark)
    rows = [(k, "w " * 100, "a") for k in range(200)] + [(999, "w " * 20_000, "a")] + [(2000 + k, "w " * 310, "b") for k in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 9)).collect()
    by = {}
    for r in got:
        by.setdefault(r["target"], []).append(r["taken"])
    for target, taken in by.items():
        assert abs(sum(taken) - target) <= 0.01 * target + 100


def test_links_are_whole_at_any_limit(spark):
    assert simhash.BLOCKS == ((0, 21), (21, 21), (42, 22))
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (1, 2, 3, 4, 6, 7)]
    # A bit in each of three blocks: no block of the limit 2 agrees.
    prints = np.unique(np.concatenate([base, *(base[k::7] ^ np.uint64(f) for k, f in enumerate([*flips, 1 | 1 << 30 | 1 << 60]))]))
    table = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    apart = np.bitwise_count(prints[:, None] ^ prints[None])
    for limit in (0, 2, 3, 6):
        start = np.arange(len(prints))
        want = simhash.merged(start.copy(), *np.nonzero(apart <= limit))
        links = np.array([(r["a"], r["b"]) for r in simhash.link_fingerprints(table, limit).collect()], np.int64).reshape(-1, 2).view(np.uint64)
        assert (simhash.merged(start.copy(), *np.searchsorted(prints, links.T)) == want).all()
    for limit in (-1, 64):
        with pytest.raises(ValueError):
            simhash.link_fingerprints(table, limit)


def test_no_record_is_lost_when_splits_change(spark, tmp_path):
    import random

    from drywell.llm import warc

    rng = random.Random(3)
    rows = [(k, f"u{k}", "<p>one</p>" * 20 if k % 6 else f"<p>other {k % 30}</p>" * 20) for k in range(600)]
    rows += [(7, "again", "<p>one</p>" * 20), (1, "u1", "<p>one</p>" * 20), (1, "u1", "<p>one</p>" * 20), (None, "n", "<p>one</p>" * 20), (None, "n", "<p>none</p>" * 20), (None, "n", "<p>none</p>" * 20)]
    rng.shuffle(rows)
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8).write.parquet(path)
    least = {}
    for page, _, html in rows:
        least[html] = min(least.get(html, 10**9), 10**9 if page is None else page)
    before = warc.decisions

    def moved(pages):  # the splits of every later read differ
        spark.conf.set("spark.sql.files.minPartitionNum", "1" if spark.conf.get("spark.sql.files.minPartitionNum", "16") == "16" else "16")
        return before(pages)

    try:
        warc.decisions = moved
        spark.conf.set("spark.sql.files.minPartitionNum", "16")
        manifest = warc.write_packages(spark.read.parquet(path), common.fresh(spark, "w"))
        got = warc.read_packages(manifest).collect()
    finally:
        warc.decisions = before
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted((r["page_id"] is None, r["page_id"] or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    heads = [r for r in got if r["record_type"] == "response"]
    assert len(heads) == len(least) and sorted(10**9 if r["page_id"] is None else r["page_id"] for r in heads) == sorted(least.values())
    assert all(r["refers_to"] in (None, *least.values()) for r in got if r["record_type"] == "revisit")


def test_a_revisit_without_response_is_an_error(spark):
    from drywell.llm import warc

    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200)], "page_id long, url string, html string")
    before = warc.with_decisions
    try:
        warc.with_decisions = lambda rows: before(rows).where("again")
        manifest = warc.write_packages(pages, common.fresh(spark, "w"))
    finally:
        warc.with_decisions = before
    with pytest.raises(Exception, match="no response for the revisit"):
        warc.read_packages(manifest).collect()
