"""Mixing sources to target weights by Pareto order sampling.

Sources share the corpus's words by weight; a target stops at three times its source's words and the
excess is shared anew. A source's target is met in two steps: every document gets the certain whole
copies, and the rest is a sample of fixed size without replacement in which long documents are
likelier: its inclusion probabilities go by size, at most 1, and their expected words are the rest. The
sample is fixed in strata of like sizes (steps of a twelfth of a doubling), whose numbers add up to the
source's words; in a stratum documents are ranked by the odds of a random number over the odds of
their inclusion, and as many of the lowest ranks as the stratum's number are taken. Strata are
filled from the long documents to the short in three bands, and what a band's documents came to is
counted before the next is shared out, so that the last words to fill are those of short documents.
All sums are aggregates by source, stratum or bucket of ranks; only the bucket that holds a stratum's
cut is ranked row by row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

WEIGHTS, MOST_COPIES, SEED = (5, 2, 1), 3, 42
#: Strata to a doubling of size, and the sizes, as parts of a source's largest, at which the bands end.
STRATA, BANDS = 12, (16, 256)
#: The part of a source's words in the sample that may be left open rather than draw short documents beyond their odds.
SLACK = 0.01
#: Rows of a stratum for each bucket of ranks; a stratum has at least so many buckets.
BUCKET_ROWS, BUCKETS = 50_000, 64


def word_count(text):
    """Runs without ASCII white space; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """by_source (source, source_size, ...), a row for each source, with target.

    Sources go by code point, null last. In closed form: ordered by source_size / weight, a prefix of
    sources stops at `most` times its size and the others share what is left by weight; the prefix is
    the shortest after which the next source stays within its limit.
    """
    order = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))  # a row for each source
    place = F.row_number().over(order) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    t = by_source.withColumn("weight", w.cast("double")).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    up = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = up.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    t = t.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    t = t.withColumn("share", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.col("share"))
    # Every source whose level is at or above its limit stops; the first that does not sets the level.
    t = t.withColumn("stops", F.col("level") * F.col("weight") >= F.col("limit"))
    t = t.withColumn("stops", F.min(F.col("stops").cast("int")).over(up.rowsBetween(W.unboundedPreceding, 0)) == 1)
    final = F.max(F.when(~F.col("stops"), F.struct((-F.col("limit") / F.col("weight")).alias("k"), F.col("level").alias("level")))).over(everything)["level"]
    return t.withColumn("target", F.when(F.col("stops"), F.col("limit")).otherwise(final * F.col("weight"))).select(*by_source.columns, "target")


def _inclusion(rows: DataFrame) -> DataFrame:
    """rows with `lam`, the inclusion probability: proportional to size, at most 1, its expected words the source's rest.

    By distinct sizes, largest first: the k largest sizes are certain if the factor that gives the
    rest to the others would exceed 1 for them. Sums run over distinct sizes, not rows.
    """
    sizes = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"), F.max("rest").alias("rest"))
    down = W.partitionBy("source").orderBy(F.desc("size"))
    whole = W.partitionBy("source")
    n, s = F.col("n").cast("double"), F.col("size").cast("double")
    t = sizes.withColumn("square", F.sum(n * s * s).over(whole) - F.coalesce(F.sum(n * s * s).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("certain", F.coalesce(F.sum(n * s).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    # With all larger sizes certain, the factor of what is left; the first size that it keeps below 1 settles it.
    t = t.withColumn("factor", F.greatest(F.col("rest") - F.col("certain"), F.lit(0.0)) / F.col("square"))
    settled = t.where(F.col("factor") * F.col("size") < 1).groupBy("source").agg(F.max_by("factor", "size").alias("factor"))
    settled = settled.withColumnRenamed("source", "_s")
    return rows.join(settled, rows["source"].eqNullSafe(settled["_s"]), "left").drop("_s").withColumn("lam", F.when(F.col("size") <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.coalesce(F.col("factor"), F.lit(1.0)) * F.col("size")))).drop("factor")


def numbers(strata: pd.DataFrame, seed: int) -> np.ndarray:
    """How many documents each stratum of one source gives: strata (stratum, n, expected, words, need, hope, capacity, rest), ordered from large to small.

    rest are the words that the source's sample is to have, expected is the sum of the inclusion probabilities, words what a document of the sample is
    expected to have, need the words the source still wants, hope the expected words of its further bands, capacity all theirs.
    Expected numbers are scaled to what is still wanted, at most doubled, and rounded up or down at
    random, but so that the strata to come can give the rest but for SLACK of it and none goes beyond.
    """
    n, expected, words = (strata[c].to_numpy(float) for c in ("n", "expected", "words"))
    need, beyond, slack = float(strata["need"].iloc[0]), float(strata["capacity"].iloc[0]), SLACK * float(strata["rest"].iloc[0])
    to_come = np.append(np.cumsum((n * words)[::-1])[::-1][1:], 0.0) + beyond
    hoped = np.append(np.cumsum((expected * words)[::-1])[::-1], 0.0) + float(strata["hope"].iloc[0])
    out = np.zeros(len(n), np.int64)
    for k, stratum in enumerate(strata["stratum"]):
        u = (zlib.crc32(f"{seed} {strata['name'].iloc[0]} {stratum}".encode()) + 0.5) / 2**32
        wish = np.floor(expected[k] * min(2.0, max(0.0, need) / max(hoped[k], 1e-9)) + u)
        low, high = np.ceil((need - slack - to_come[k]) / words[k]), np.floor((need + slack) / words[k])
        if low > high:  # no number fits: the nearer
            wish = np.floor(need / words[k] + 0.5)
        out[k] = int(np.clip(np.clip(wish, low, max(low, high)), 0, n[k]))
        need -= out[k] * words[k]
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, row_id) of every row.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, a
    null id stays null. Random numbers go by id, text and seed, so reruns agree; rows alike in id and
    text are ordered by row_id: `row_col`, a unique number, or their place in this one read. An empty
    table gives no rows; other columns are not read.
    """
    common.prepare(docs.sparkSession)
    text = docs[text_col].cast("string")
    row = docs[row_col].cast("long") if row_col else F.monotonically_increasing_id()
    rows = docs.select(
        row.alias("row_id"), docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(text).alias("size"),
        # A number in (0, 1).
        ((F.pmod(F.xxhash64(docs[id_col].cast("long"), text, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))).alias("u"),
    )
    rows = common.written(rows, "sizes")
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest")), weights, most)
    by_source = common.written(
        by_source.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))),
        "targets",
    ).withColumnRenamed("source", "_source")
    rows = rows.join(by_source, rows["source"].eqNullSafe(by_source["_source"])).drop("_source")
    rows = _inclusion(rows)
    # Odds of the random number over the odds of inclusion; certain documents rank first.
    odds, size = F.col("u") / (1 - F.col("u")), F.col("size")
    rank = F.when(F.col("lam") >= 1, F.lit(0.0)).when(F.col("lam") > 0, odds * (1 - F.col("lam")) / F.col("lam"))
    stratum = F.floor(F.log2("size") * STRATA + F.lit(1e-9)).cast("int")
    band = sum((size * edge <= F.col("largest")).cast("int") for edge in BANDS)
    rows = common.written(rows.withColumn("rank", rank).withColumn("stratum", F.when(size > 0, stratum)).withColumn("band", band), "ranked")
    live = rows.where("rank is not null and rest > 0")
    n, s, lam = F.count("*"), F.sum(F.col("lam") * size), F.sum("lam")
    strata = live.groupBy("source", "band", "stratum").agg(n.cast("double").alias("n"), lam.alias("expected"), (s / lam).alias("words"), F.sum("size").alias("all"), F.first("rest").alias("rest"))
    strata = common.written(strata, "strata")
    taken = None
    for k in range(len(BANDS) + 1):
        own = strata.where(F.col("band") == k)
        later = strata.where(F.col("band") > k).groupBy("source").agg(F.sum("all").cast("double").alias("capacity"), F.sum(F.col("expected") * F.col("words")).alias("hope")).withColumnRenamed("source", "_s")
        own = own.join(later, own["source"].eqNullSafe(later["_s"]), "left").drop("_s").fillna(0.0, ["capacity", "hope"])
        if taken is None:
            own = own.withColumn("need", F.col("rest"))
        else:
            had = taken.groupBy(F.col("source").alias("_s")).agg(F.sum("size").alias("had"))
            own = own.join(had, own["source"].eqNullSafe(had["_s"]), "left").drop("_s").withColumn("need", F.col("rest") - F.coalesce("had", F.lit(0)))
        got = _band(live.where(F.col("band") == k), own, seed)
        taken = got if taken is None else taken.unionByName(got)
    more = taken.select(F.col("row_id").alias("_row"))
    rows = rows.join(more, rows["row_id"] == more["_row"], "left")
    rows = rows.withColumn("copies", F.when(size > 0, F.col("whole") + F.col("_row").isNotNull().cast("long")).otherwise(F.lit(0)).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * size).alias("taken"), "copies", "row_id")


def _band(rows: DataFrame, strata: DataFrame, seed: int) -> DataFrame:
    """(row_id, source, size) of the rows that a band's strata give, stored: of each stratum as many of the lowest ranks as its number."""

    def share(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("stratum", ascending=False, ignore_index=True)
        return pd.DataFrame({"_s": own["source"], "_t": own["stratum"], "rows": own["n"].astype("int64"), "number": numbers(own.assign(name=own["source"]), seed)})

    # A few rows for each source.
    given = strata.groupBy("source").applyInPandas(share, "_s string, _t int, rows long, number long").where("number > 0")
    given = common.written(given, "numbers")
    rows = rows.join(given, rows["source"].eqNullSafe(given["_s"]) & (rows["stratum"] == given["_t"])).drop("_s", "_t")
    buckets = F.greatest(F.lit(BUCKETS), (F.col("rows") / BUCKET_ROWS).cast("long"))
    rows = rows.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets))
    each = rows.groupBy("source", "stratum", "bucket").agg(F.count("*").alias("n"), F.first("number").alias("number"))
    upto = F.sum("n").over(W.partitionBy("source", "stratum").orderBy("bucket"))
    each = each.withColumn("left", F.col("number") - (upto - F.col("n"))).where("left > 0").select(F.col("source").alias("_s"), F.col("stratum").alias("_t"), F.col("bucket").alias("_b"), "left", (F.col("left") >= F.col("n")).alias("all"))
    rows = rows.join(each, rows["source"].eqNullSafe(F.col("_s")) & (F.col("stratum") == F.col("_t")) & (F.col("bucket") == F.col("_b")))
    cut = rows.where("not all").withColumn("place", F.row_number().over(W.partitionBy("source", "stratum").orderBy("rank", "doc_id", "row_id"))).where("place <= left")
    return common.written(rows.where("all").select("row_id", "source", "size").unionByName(cut.select("row_id", "source", "size")), "taken")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs in the mix: each row as often as it is taken, with all its columns.

    Rows are stored with a number of their own first and told apart by it, so null and repeated ids
    lose nothing. Rows without words are never taken; an empty table stays empty.
    """
    row, n, copy = (common.free(docs, x) for x in ("_row", "_copies", "_copy"))
    stored = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    copies = mix(stored, id_col=id_col, text_col=text_col, source_col=source_col, row_col=row).where("copies > 0").select(F.col("row_id").alias(row), F.col("copies").alias(n))
    rows = stored.join(copies, row)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*(rows[c] for c in docs.columns))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).drop("row_id")
