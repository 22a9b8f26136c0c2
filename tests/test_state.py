"""Grouped folds by counts, and states of a stream that stop, resume, run again and compact."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from drywell.operators import consistency, folds
from drywell.streaming import months


def plain_folds(sizes, k):
    heap, out = [(0, f) for f in range(1, k + 1)], {}
    for name, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, fold = heapq.heappop(heap)
        out[name] = fold
        heapq.heappush(heap, (load + n, fold))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_the_heap(seed):
    rng = random.Random(seed)
    k = rng.randint(1, 7)
    sizes = [n for n in sorted({rng.randint(1, rng.choice([3, 30, 1000])) for _ in range(rng.randint(1, 9))}, reverse=True)]
    plan = [(n, rng.randint(1, rng.choice([2, 40]))) for n in sizes]
    names = {f"{n:04d}-{i:03d}": n for n, m in plan for i in range(m)}
    want, runs = plain_folds(names, k), folds.deal(plan, k)
    assert len(runs) <= k * len(plan)
    for size, first, length, turn in runs:
        for i in range(length):
            assert want[f"{size:04d}-{first + i:03d}"] == turn[i % len(turn)]
    assert sum(length for _, _, length, _ in runs) == len(names)


def test_grouped_folds_equal_the_heap(spark):
    rng = random.Random(1)
    sizes = {f"s{i:03d}": rng.choice([1, 1, 1, 2, 2, 3, 7, 40]) for i in range(300)}
    df = spark.createDataFrame([(g, j) for g, n in sizes.items() for j in range(n)], "g string, j int").repartition(5)
    got = {r["g"]: (r["n"], r["fold"]) for r in folds.grouped_folds(df, "g", 4).collect()}
    want = plain_folds(sizes, 4)
    assert got == {g: (n, want[g]) for g, n in sizes.items()}
    named = spark.createDataFrame([(None,), (None,), ("a",), ("b",)], "g string")
    assert {r["g"]: r["fold"] for r in folds.grouped_folds(named, "g", 2).collect()} == {None: 1, "a": 2, "b": 2}
    with pytest.raises(ValueError):
        folds.grouped_folds(named, "g", 4)


MONTHS = [f"2000-{m:02d}" for m in range(1, 13)]


def batch_of(spark, month):
    rng = random.Random(month)
    return spark.createDataFrame([("p", 3, f"2000-{month:02d}", r, c, rng.random(), rng.random(), (r + c) % 3) for r in range(2) for c in range(5)], months.REGIONAL)


def same(a, b, keys):
    near = lambda df: {tuple(r[k] for k in keys): [None if r[c] is None else round(r[c], 9) for c in sorted(set(df.columns) - set(keys))] for r in df.collect()}
    return near(a) == near(b)


def test_states_that_stop_resume_and_compact(spark, tmp_path, monkeypatch):
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    run = lambda: months.accumulate_state(spark, src, out, check, (2, 5), MONTHS, compact=2)
    seen = None
    for m in range(1, 7):
        own = batch_of(spark, m)
        seen = own if seen is None else seen.unionByName(own)
        own.coalesce(1).write.mode("append").parquet(src)
        if m == 4:  # the run dies after the batch's sums are stored and compacted, before the stream knows
            real = months._parts
            calls = []

            def dies(target, kind):
                calls.append(kind)
                if len(calls) == 3:
                    raise RuntimeError("lost")
                return real(target, kind)

            monkeypatch.setattr(months, "_parts", dies)
            with pytest.raises(Exception):
                run()
            monkeypatch.setattr(months, "_parts", real)
        run()
        keys = ["product", "scale", "row", "col"]
        assert same(months.pixel_state(spark, out), consistency.pixel_correlation(consistency.partial_sums(seen, keys), keys), keys)
        assert same(months.region_state(spark, out), consistency.by_region(seen, ["product", "scale"]), ["product", "scale", "region_id"])
    last, later = months._parts(out, "pixel")
    assert last >= 3 and len(later) < 2
    run()  # nothing new
    assert months.pixel_state(spark, out).agg(F.sum("n")).first()[0] == 60


def test_states_refuse_another_grid_or_months(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    batch_of(spark, 1).write.parquet(src)
    months.accumulate_state(spark, src, out, check, (2, 5), MONTHS)
    for shape, listed in (((3, 5), MONTHS), ((2, 5), MONTHS[:6])):
        with pytest.raises(ValueError):
            months.accumulate_state(spark, src, out, check, shape, listed)
    batch_of(spark, 2).withColumn("row", F.lit(9)).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="outside"):
        months.accumulate_state(spark, src, out, check, (2, 5), MONTHS)


def test_alerts_count_low_readings_by_window(spark, tmp_path):
    rows = [("a", "2000-01-05 00:00:00", -2.0), ("a", "2000-01-06 00:00:00", 0.5), ("b", "2000-01-07 00:00:00", -1.0), ("a", "2000-06-01 00:00:00", -3.0)]
    spark.createDataFrame(rows, "station_id string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = months.monthly_alerts(spark, str(tmp_path / "in"), "station_id string, ts timestamp, value double")
    q = stream.writeStream.format("memory").queryName("alerts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["station_id"], r["n"], r["low"]) for r in spark.table("alerts").collect()) == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1)]
