"""Large capacities, ids at both ends of a long, tokenizers under other names."""

import random
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from drywell.llm import common, fingerprint, media, packing, simhash, tokens

from .test_cases import check_packed


@pytest.mark.parametrize("capacity", [2048, 8192, 32_768, 200_000])
def test_packing_at_any_capacity(spark, capacity):
    common.prepare(spark)
    rng = np.random.default_rng(capacity)
    lengths = [*rng.integers(1, capacity + 1, 300).tolist(), *[capacity] * 40, *[capacity // 2] * 31, *[capacity // 3] * 20, *[1] * 50]
    items = common.written(spark.createDataFrame([(k, k, 0, 0, n, 0) for k, n in enumerate(lengths)], packing.PIECES), "items")
    got = packing.pack(items, capacity).collect()
    assert sorted(r["length"] for r in got) == sorted(lengths)
    assert check_packed(got, capacity) <= 1.25 * sum(lengths) / capacity + 1


def test_next_rows_of_ids_that_lie_far_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "KNOTS", 4)
    common.prepare(spark)
    ends = [-(1 << 63) + k for k in range(60)] + [(1 << 63) - 1 - k for k in range(60)] + [(1 << 62) + k for k in range(5)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ends], "doc_id long, text string")
    order = sorted(ends)
    want = {i: f"text {j}" for i, j in zip(order, order[1:] + order[:1])}
    assert {r["doc_id"]: r["next"] for r in fingerprint.with_next(docs).collect()} == want


def test_tokenizers_are_told_by_their_contents(tmp_path):
    given = tokens.tokenizer_path()
    other = tokens.tokenizer_path("byte_bpe_50k.json")
    shutil.copy(given, tmp_path / "own.json")
    shutil.copy(other, tmp_path / tokens.NAME)
    assert tokens.Encoder(str(tmp_path / "own.json")).in_parts
    assert not tokens.Encoder(str(tmp_path / tokens.NAME)).in_parts


def test_text_elements_do_not_meet_in_one_task(spark):
    common.prepare(spark)
    pages = spark.createDataFrame([(k, "<p>one</p><p>two</p><p>three</p>") for k in range(200)], "doc_id long, html string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = media.resolve(media.sequences(pages, "doc_id", "html"), spark.createDataFrame([], media.FEATURES))
        from pyspark.sql import functions as F

        parts = [r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(parts) == 600 and max(parts) < 300


def test_stages_remove_what_earlier_ones_wrote(spark, tmp_path):
    import os

    import corpus_pipeline

    top = common.shared_dir(spark).removeprefix("file://")
    corpus_pipeline._left.clear()
    there = set(os.listdir(top))
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[1:4], 1):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert {int(x.split("-")[1]) for x in set(os.listdir(top)) - there if x.startswith("stage-")} <= {k}
    assert docs.count() > 0
    corpus_pipeline._left.clear()


def test_no_link_of_short_near_copies_is_left_to_chance(spark):
    rng, texts = random.Random(3), []
    for _ in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(10)]
        texts += [" ".join(words), " ".join(words[:-1])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == list(range(0, 800, 2))


def test_exact_links_do_not_need_the_searches_by_chance(spark):
    rng, texts = random.Random(4), [None, "", " \n", "one two", "two one"]
    for _ in range(40):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 60))]
        for _ in range(3):
            words = words[: rng.randrange(len(words))] + words[rng.randrange(len(words)) :] if rng.random() < 0.3 else [*words[:-1], f"w{rng.randrange(60)}"]
            texts.append(" ".join(words))
    rows = spark.createDataFrame([(i, str(i).encode(), t or "") for i, t in enumerate(dict.fromkeys(t or "" for t in texts))], "id long, key binary, text string")
    heads = lambda turns: {bytes(r["key"]) for r in simhash.near_copies(rows, turns).where("head").collect()}
    found = heads(0)
    assert found == heads(1)
    sets = [set(simhash.shingle_hashes(r["text"], simhash.NEAR_WORDS).tolist()) for r in rows.orderBy("id").collect()]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert found == {str(i).encode() for i in range(len(sets)) if root[i] == i}


def test_near_dedup_moves_texts_only_where_pairs_name_them(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(1500)) for _ in range(80)]
    texts += [texts[0], texts[1].rsplit(" ", 3)[0]]  # an exact and a near copy
    docs = common.written(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "t")
    store, bus = spark._jsc.sc().statusStore(), spark._jsc.sc().listenerBus()

    def moved():
        bus.waitUntilEmpty()
        return store.executorList(True).apply(0).totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        before = moved()
        assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == list(range(80))
        assert moved() - before < 2 * sum(map(len, texts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_of_rows_pass_all_that_are_named(spark):
    from pyspark.sql import functions as F

    rows = common.written(spark.range(20_000).select("id", F.xxhash64("id").alias("h")), "t")
    may = simhash.membership(rows.where("id % 10 = 0").select("h"))
    passed = {r["id"] for r in rows.where(may("h")).collect()}
    assert set(range(0, 20_000, 10)) <= passed and len(passed) < 4000
    none = simhash.membership(rows.where("id < 0").select("h"))
    assert rows.where(none("h")).isEmpty()


def test_op9_larger_sketches_recover_all_and_cost_little(spark):
    """Versions that stored sketches can't tell apart: every digest comes out of larger sketches, in a few times what the stored ones take."""
    rng = random.Random(9)
    some = lambda n: [rng.getrandbits(64) - 2**63 for _ in range(n)]
    rows = [(some(rng.randrange(60)), some(rng.randrange(60)), some(rng.randrange(90))) for _ in range(2000)] + [(some(30_000), some(20_000), some(40_000)), ([], [], []), ([1], [], [])]
    rows = [(both + one, two + both) for one, two, both in rows]
    table = spark.createDataFrame(rows, "a array<long>, b array<long>").repartition(4).selectExpr("*", f"{fingerprint.sketch('a')} AS sa", f"{fingerprint.sketch('b')} AS sb").persist()
    found = table.select("a", "b", F.expr(fingerprint.larger("a", "b")).alias("d")).collect()
    assert len(found) == len(rows)
    for r in found:
        a, b = set(r["a"]), set(r["b"])
        assert r["d"]["ok"] and sorted(r["d"]["added"]) == sorted(a - b) and sorted(r["d"]["removed"]) == sorted(b - a)

    def seconds(df):
        times = []
        for _ in range(3):
            at = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - at)
        return min(times)

    usual = table.where(F.size("a") < 1000)
    base = seconds(usual.selectExpr(fingerprint.sketch("a"), fingerprint.sketch("b")))
    assert seconds(fingerprint.differences(usual, "d", "a", "b", "sa", "sb")) < 2.5 * base
    table.unpersist()
