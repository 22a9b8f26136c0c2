"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in Spark SQL only.

A paragraph is a run of up to RUN words that ends where a sentence or a line ends, in texts of any
size. A sketch is an array of cells (count, XOR of digests, XOR of check values); a paragraph's
digest falls into one cell of each of three thirds. Two versions' sketches subtract cell by cell, and
only the digests that differ are left; peeling takes digests from cells that hold a single one until
no cell is left. Where that stalls, a larger sketch takes its place, whose parts have cells by the
number of digests that earlier parts left. The work grows with the text, not its square; all of a
row's stays in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Cells of the stored sketch (a multiple of three), and rounds of peeling after which a larger sketch is tried.
CELLS, ROUNDS = 24, 10
#: Cells for each digest of both versions in a part of a larger sketch, and parts at most.
EACH, PARTS = 3, 24
#: Words of a paragraph at most.
RUN = 16
CHECK, LARGE_CHECK = "(xxhash64({k}, 77) & 4294967295L)", "xxhash64({k}, 77)"
#: Quantiles of the ids that the buckets of the order are made of: at least, at most, and rows for each; and rows of a bucket.
KNOTS, MOST_KNOTS, KNOT_ROWS, BUCKET_ROWS = 64, 4096, 250_000, 20_000


def digests(text: Column) -> Column:
    """Digests of the distinct paragraphs of a text; none without words."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?:\S++(?<![.!?])[ \t]++){{0,{RUN - 1}}}\S++"), F.lit(0))
    return F.array_distinct(F.transform(runs, lambda p: F.xxhash64(p)))


def let(value: str, name: str, body: str) -> str:
    """body with `name` for the value, computed once."""
    return f"aggregate(array(), {value}, (a, e) -> a, {name} -> {body})"


def third(cells: str) -> str:
    return f"(({cells}) div 3)"


def place(k: str, j: int, cells: str, seed: str) -> str:
    """The cell of a digest in third j."""
    return f"cast(pmod(xxhash64({k}, {seed}, {j}), {third(cells)}) + {j} * {third(cells)} as int)"


def sketch(keys: str, cells: str = str(CELLS), seed: str = "0") -> str:
    """Cells of the digests: array of (c, k, x)."""
    placed = f"transform({keys}, k -> struct(k AS k, {CHECK.format(k='k')} AS x, " + ", ".join(f"{place('k', j, cells, seed)} AS p{j}" for j in range(3)) + "))"
    parts = ", ".join(
        f"transform(sequence({j} * {third(cells)}, {j + 1} * {third(cells)} - 1), i -> aggregate(filter(es, e -> e.p{j} = i), named_struct('c', 0, 'k', 0L, 'x', 0L), "
        "(a, e) -> named_struct('c', a.c + 1, 'k', a.k ^ e.k, 'x', a.x ^ e.x)))"
        for j in range(3)
    )
    return let(placed, "es", f"concat({parts})")


def peeled(a: str, b: str, cells: str = str(CELLS), seed: str = "0", rounds: int = ROUNDS) -> str:
    """(ok, added, removed): digests of sketch a only and of sketch b only; ok if all cells came empty."""
    start = f"transform({a}, (u, i) -> named_struct('i', i, 'c', u.c - {b}[i].c, 'k', u.k ^ {b}[i].k, 'x', u.x ^ {b}[i].x))"
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.c) = 1 AND c.x = {CHECK.format(k='c.k')}), c -> named_struct('s', c.c, 'k', c.k)))"
    places = ", ".join(f"'p{j}', {place('p.k', j, cells, seed)}" for j in range(3))
    taken = f"transform(ps, p -> named_struct('s', p.s, 'k', p.k, 'x', {CHECK.format(k='p.k')}, {places}))"
    left = (
        "transform(s.cells, c -> aggregate(filter(qs, q -> q.p0 = c.i OR q.p1 = c.i OR q.p2 = c.i), c, "
        "(t, q) -> named_struct('i', t.i, 'c', t.c - q.s, 'k', t.k ^ q.k, 'x', t.x ^ q.x)))"
    )
    some = "c -> c.c != 0 OR c.k != 0 OR c.x != 0"
    go_on = let(taken, "qs", f"named_struct('cells', filter({left}, {some}), 'got', concat(s.got, ps), 'done', false)")
    step = f"CASE WHEN s.done THEN s ELSE {let(pure, 'ps', f"CASE WHEN size(ps) = 0 THEN named_struct('cells', s.cells, 'got', s.got, 'done', true) ELSE {go_on} END")} END"
    zero = f"named_struct('cells', filter({start}, {some}), 'got', cast(array() as array<struct<s:int,k:bigint>>), 'done', false)"
    finish = (
        "s -> named_struct('ok', size(s.cells) = 0, "
        "'added', transform(filter(s.got, g -> g.s = 1), g -> g.k), 'removed', transform(filter(s.got, g -> g.s = -1), g -> g.k))"
    )
    return f"aggregate(sequence(1, {rounds}), {zero}, (s, r) -> {step}, {finish})"


def larger(a: str, b: str) -> str:
    """(ok, added, removed) between digest arrays a and b of any size, from the difference of two larger sketches; ok if all cells came empty.

    Such a sketch has parts instead of thirds, which are peeled in turn, and a digest falls into one cell
    of each. Taking what earlier parts gave out of a part's cells is the same as not adding it, so a part
    sums only digests of cells that are neither empty nor pure in the one before, and has cells by their
    number. A part's places are sorted: its work grows with its digests, not with digests times cells.
    """
    digest = lambda v: f"ks[cast({v} & 4294967295L as int)]"
    same = lambda v, w: f"shiftright({v}, 32) <=> shiftright({w}, 32)"
    placed = f"sort_array(transform(s.rest, n -> shiftleft(pmod(xxhash64(ks[n], r), {EACH} * size(s.rest) + {EACH}L), 32) | n))"
    sole = f"filter(o, (v, n) -> NOT {same('v', 'get(o, n - 1)')} AND NOT {same('v', 'get(o, n + 1)')})"
    ends = f"CASE WHEN size(w) = 0 THEN cast(array() as array<int>) ELSE filter(sequence(1, size(w)), n -> NOT {same('w[n - 1]', 'get(w, n)')}) END"
    summed = (
        "aggregate(sequence(f, e - 1), named_struct('c', 0, 'k', 0L, 'x', 0L), "
        f"(t, n) -> named_struct('c', t.c + CASE WHEN w[n] & 4294967295L < size({a}) THEN 1 ELSE -1 END, 'k', t.k ^ {digest('w[n]')}, 'x', t.x ^ {LARGE_CHECK.format(k=digest('w[n]'))}), "
        f"t -> named_struct('c', t.c, 'k', t.k, 'f', f, 'e', e, 'done', t.c = 0 AND t.k = 0 AND t.x = 0 OR abs(t.c) = 1 AND t.x = {LARGE_CHECK.format(k='t.k')}))"
    )
    cells = f"transform(es, (e, j) -> {let('coalesce(get(es, j - 1), 0)', 'f', summed)})"
    own = lambda sign, c: f"transform(filter(u, v -> v & 4294967295L {sign} size({a})), v -> {digest('v')}), transform(filter(cs, c -> c.done AND c.c = {c}), c -> c.k)"
    left = "flatten(transform(filter(cs, c -> NOT c.done), c -> transform(slice(w, c.f + 1, c.e - c.f), v -> cast(v & 4294967295L as int))))"
    found = f"named_struct('rest', {left}, 'up', concat(s.up, {own('<', 1)}), 'down', concat(s.down, {own('>=', -1)}))"
    part = let(placed, "o", let(sole, "u", let("array_except(o, u)", "w", let(ends, "es", let(cells, "cs", found)))))
    zero = "named_struct('rest', transform(ks, (k, n) -> n), 'up', cast(array() as array<bigint>), 'down', cast(array() as array<bigint>))"
    finish = "s -> named_struct('ok', size(s.rest) = 0, 'added', s.up, 'removed', s.down)"
    return let(f"concat({a}, {b})", "ks", f"aggregate(sequence(1, {PARTS}), {zero}, (s, r) -> CASE WHEN size(s.rest) = 0 THEN s ELSE {part} END, {finish})")


def as_text(cells: Column) -> Column:
    """A sketch as hex: count, digest and check value of each cell."""
    return F.array_join(F.transform(cells, lambda u: F.concat(F.lpad(F.hex(u["c"]), 3, "0"), F.lpad(F.hex(u["k"]), 16, "0"), F.lpad(F.hex(u["x"]), 8, "0"))), "")


def differences(rows: DataFrame, name: str, a: str, b: str, sa: str, sb: str) -> DataFrame:
    """rows with `name`, (ok, added, removed) between two digest arrays a and b, whose stored sketches are sa and sb.

    First the stored sketches. Where they don't peel, larger ones take their place; versions whose
    larger sketches stall in every part are told apart by their digests. All differences are
    recovered: ok is always true.
    """
    # Sketches whose sizes alone differ by more than their cells can't peel.
    own = rows.withColumns({"_a": F.col(a), "_b": F.col(b), "_u": F.col(sa), "_v": F.col(sb)}).withColumn("_d", F.expr(f"CASE WHEN abs(size(_a) - size(_b)) <= {CELLS} THEN {peeled('_u', '_v')} END"))
    own = own.withColumn("_d", F.expr(f"CASE WHEN coalesce(_d.ok, false) THEN _d ELSE {larger('_a', '_b')} END"))
    own = own.withColumn(name, F.expr("CASE WHEN _d.ok THEN _d ELSE named_struct('ok', true, 'added', array_except(_a, _b), 'removed', array_except(_b, _a)) END"))
    return own.drop("_a", "_b", "_u", "_v", "_d")


def likeness(name: str, a: str, b: str) -> Column:
    """The share of digests that both have: 1 less the recovered differences over both sizes; 1 for two texts without words."""
    d = F.size(F.col(name)["added"]) + F.size(F.col(name)["removed"])
    n = F.size(a) + F.size(b)
    return F.when(n > 0, (n - d) / n).otherwise(F.lit(1.0))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): each row with the text of the row after it by doc_id (null last), then the hash of its text and the text; after the last the first.

    Rows go into buckets of the id order, as many as the rows ask for; rows of one id that is a
    quantile, and rows without an id, are dealt on by the hash of their text. Each bucket's first
    text is added to the bucket before as its last row, so a window in each bucket finds every next
    row and no order runs over all rows.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("_h", F.xxhash64("text"))
    total = docs.count()
    n = min(MOST_KNOTS, max(KNOTS, total // KNOT_ROWS))
    found = docs.where("doc_id is not null").agg(F.percentile_approx("doc_id", [k / n for k in range(n + 1)], 10_000).alias("q")).first()["q"] or [0]
    knots = sorted(set(found))
    fine = max(1, -(-max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS) // len(knots)))
    held = F.array(*(F.lit(k).cast("long") for k in knots))
    rows = rows.withColumn("_k", F.when(F.col("doc_id").isNull(), F.lit(len(knots) + 1)).otherwise(F.size(F.filter(held, lambda b: b <= F.col("doc_id")))))
    # In the stretch between two quantiles, equal steps; at a quantile and without an id, equal steps of the hash.
    low = F.when(F.col("_k").between(1, len(knots)), F.element_at(held, F.greatest(F.col("_k"), F.lit(1)).cast("int")))
    high = F.when(F.col("_k").between(1, len(knots) - 1), F.element_at(held, F.least(F.col("_k") + 1, F.lit(len(knots))).cast("int")))
    apart = lambda a, b: a.cast("double") - b.cast("double")  # noqa: E731  ids may lie farther apart than a long reaches
    step = F.coalesce(F.least(F.floor(apart(F.col("doc_id"), low) / F.greatest(apart(high, low), F.lit(1.0)) * fine), F.lit(fine - 1)), F.lit(0))
    by_hash = F.floor((F.shiftright("_h", 32) + F.lit(1 << 31)) * F.lit(fine) / F.lit(1 << 32))
    sub = F.when(F.col("doc_id").isNull() | (F.col("doc_id") == low), by_hash).otherwise(fine + step)
    bucket = (F.col("_k") * (2 * fine) + sub).cast("long")
    rows = rows.withColumn("bucket", bucket).drop("_k")
    order = (F.col("doc_id").asc_nulls_last(), F.col("_h"), F.col("text"))
    # A text for each bucket, stored; only the buckets' numbers are ordered in one task.
    heads = common.written(rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h", "text")).alias("head")), "heads").select("bucket", "head.text")
    by_bucket = W.orderBy("bucket")
    before = heads.select("bucket", F.coalesce(F.lag("bucket").over(by_bucket), F.max("bucket").over(W.partitionBy())).alias("before"))
    ends = heads.join(before, "bucket").select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("_h"), F.col("before").alias("bucket"), F.lit(1).alias("_end"))
    both = rows.select("doc_id", "text", "_h", "bucket", F.lit(0).alias("_end")).unionByName(ends)
    w = W.partitionBy("bucket").orderBy("_end", *order)
    return both.withColumn("next", F.lead("text").over(w)).where("_end = 0").select("doc_id", "text", "next")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the numbers of paragraphs added and removed by the edit) of every row.

    Null texts are empty; texts without words have no paragraph and are alike. A null id stays null
    and comes last in the order; rows that repeat an id follow each other by the hash of their text; a
    sole row is its own next. Repeated paragraphs count once. A text of any length and number of lines
    is compared whole. Other columns are not read; an empty table gives no rows.
    """
    common.prepare(docs.sparkSession)
    rows = with_next(docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next, 1, cast(n_chars div 4 as int)))"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        *(digests(F.col(text)).alias(name) for text, name in (("text", "own"), ("edited", "changed"), ("next", "following"))),
    )
    rows = rows.withColumns({f"sketch{k}": F.expr(sketch(name)) for k, name in enumerate(("own", "changed", "following"))})
    rows = differences(rows, "edit", "own", "changed", "sketch0", "sketch1")
    rows = differences(rows, "step", "own", "following", "sketch0", "sketch2")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch0")).alias("fingerprint"), as_text(F.col("sketch1")).alias("edited_fingerprint"),
        likeness("edit", "own", "changed").alias("near_edited"), likeness("step", "own", "following").alias("near_next"),
        F.size("edit.added").alias("paragraphs_left"), F.size("edit.removed").alias("paragraphs_new"),
    )


def op9_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(common.table(spark, sf_dir, "documents"))
