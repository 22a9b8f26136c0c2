"""Centroid clustering of whole-number vectors by kd-tree filtering.

Every partition's vectors go into kd-trees whose nodes hold a count, whole-number sums and a box.
A round takes all trees from the top down: of the centroids that may still be nearest to something in
a node's box, the one nearest to its middle is compared with the others, and those that are farther
than it everywhere in the box are dropped. A node with one centroid left is counted as a whole, a
leaf with several is decided vector by vector. Ties are never dropped, so the results are exact. Only
sums by centroid leave a task: at most (centroids x (components + 1)) numbers meet on the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Vectors of a tree and of a leaf. A tree is one row of a stored table, of about 1.5 MB.
POINTS, LEAF = 4096, 32
#: Components lie below this, so that every squared distance fits a long.
MOST = 1 << 27
TREES = "ids array<long>, points binary, nodes binary, boxes binary, sums binary"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of vectors with exactly `dims` components, none null, NaN or infinite."""
    given = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("x"))
    finite = given.where((F.size("x") == dims) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return finite.select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


class Tree:
    """A kd-tree of at most POINTS vectors: points in tree order, nodes as (start, stop, left, right); left is -1 for leaves."""

    def __init__(self, points: np.ndarray, nodes: np.ndarray, boxes: np.ndarray, sums: np.ndarray):
        self.points, self.nodes, self.boxes, self.sums = points, nodes, boxes, sums

    @classmethod
    def grown(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of an (n, dims) array, and the order in which it holds the points. Copies of a vector share a leaf of any size."""
        order = np.arange(len(points))
        nodes, boxes, sums = [[0, len(points), -1, -1]], [], []
        k = 0
        while k < len(nodes):
            start, stop = nodes[k][:2]
            own = points[order[start:stop]]
            low, high = own.min(0), own.max(0)
            boxes.append((low, high))
            sums.append(own.sum(0))
            wide = int((high - low).argmax())
            if stop - start > LEAF and low[wide] < high[wide]:
                x = own[:, wide]
                middle = np.partition(x, len(x) // 2)[len(x) // 2]
                left = x <= middle if middle < high[wide] else x < middle
                order[start:stop] = np.concatenate([order[start:stop][left], order[start:stop][~left]])
                cut = start + int(left.sum())
                nodes[k][2:] = len(nodes), len(nodes) + 1
                nodes += [[start, cut, -1, -1], [cut, stop, -1, -1]]
            k += 1
        return cls(points[order], np.array(nodes, np.int64), np.array(boxes), np.array(sums)), order

    def nearest(self, centroids: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(counts, sums by centroid, label of each point, squared distance of each); the last two only if asked for."""
        dims, k = centroids.shape[1], len(centroids)
        largest = max(1, int(np.abs(centroids).max(initial=1)), int(np.abs(self.boxes).max(initial=1)))
        # Whole numbers are exact in either type: products and their sums stay below 2**53 or 2**63.
        kind = np.float64 if 16 * dims * largest * largest < 1 << 53 else np.int64
        c = centroids.astype(kind)
        norm = (c * c).sum(1)
        low, high = self.boxes[:, 0].astype(kind), self.boxes[:, 1].astype(kind)
        steps = c[None] - c[:, None]  # [a, z]: from centroid a to z
        up, down = np.maximum(steps, 0), np.minimum(steps, 0)
        label = np.full(len(self.points), -1)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        # Of equal centroids the first takes all.
        first = np.zeros(k, bool)
        first[np.unique(centroids, axis=0, return_index=True)[1]] = True
        front, may = np.zeros(1, np.int64), first[None].copy()
        leaves: list[tuple[np.ndarray, np.ndarray]] = []
        while len(front):
            middle = (low[front] + high[front]) @ c.T
            star = np.where(may, norm - middle, np.inf if kind is np.float64 else np.iinfo(np.int64).max).argmin(1)
            for a in np.unique(star):
                own = np.flatnonzero(star == a)
                gain = high[front[own]] @ up[a].T + low[front[own]] @ down[a].T  # the most of (z - a) . x in the box
                may[own] &= norm - norm[a] - 2 * gain <= 0
            single = may.sum(1) == 1
            np.add.at(counts, star[single], self.nodes[front[single], 1] - self.nodes[front[single], 0])
            np.add.at(sums, star[single], self.sums[front[single]])
            if each:
                for node, z in zip(front[single], star[single]):
                    label[self.nodes[node, 0] : self.nodes[node, 1]] = z
            leaf = ~single & (self.nodes[front, 2] < 0)
            if leaf.any():
                leaves.append((front[leaf], may[leaf]))
            inner = ~single & ~leaf
            below = self.nodes[front[inner], 2:]
            front, may = below.reshape(-1), np.repeat(may[inner], 2, axis=0)
        if leaves:
            front, may = (np.concatenate(x) for x in zip(*leaves))
            sizes = self.nodes[front, 1] - self.nodes[front, 0]
            at = np.repeat(self.nodes[front, 0] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            points = self.points[at]
            far = norm - 2 * (points.astype(kind) @ c.T)
            far[~np.repeat(may, sizes, axis=0)] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
            z = far.argmin(1)
            label[at] = z
            np.add.at(counts, z, 1)
            for one in np.unique(z):
                sums[one] += points[z == one].sum(0)
        distance = np.zeros(len(self.points), np.int64)
        if each:
            distance = ((self.points - centroids[label]) ** 2).sum(1)
        return counts, sums, label, distance

    def stored(self) -> list[bytes]:
        return [self.points.tobytes(), self.nodes.tobytes(), self.boxes.tobytes(), self.sums.tobytes()]

    @classmethod
    def read(cls, points: bytes, nodes: bytes, boxes: bytes, sums: bytes, dims: int) -> Tree:
        own = lambda x: np.frombuffer(x, np.int64)
        return cls(own(points).reshape(-1, dims), own(nodes).reshape(-1, 4), own(boxes).reshape(-1, 2, dims), own(sums).reshape(-1, dims))


def trees_of(vectors: DataFrame, dims: int) -> DataFrame:
    """The stored trees of (vec_id, v): no shuffle, each task makes trees of its own rows."""

    def run(batches):
        ids: list[pa.Array] = []
        points: list[np.ndarray] = []

        def tree():
            own, order = Tree.grown(np.concatenate(points))
            kept = pa.concat_arrays(ids).take(pa.array(order))
            rows = [pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), *(pa.array([x], pa.binary()) for x in own.stored())]
            return pa.RecordBatch.from_arrays(rows, names=["ids", "points", "nodes", "boxes", "sums"])

        for batch in batches:
            given = np.asarray(batch.column(1).flatten()).astype(np.int64).reshape(-1, dims)
            if len(given) and np.abs(given).max() >= MOST:
                raise ValueError(f"components of {MOST} and more make distances that no long holds")
            at = 0
            while at < len(given):
                take = min(len(given) - at, POINTS - sum(map(len, points)))
                ids.append(batch.column(0).slice(at, take))
                points.append(given[at : at + take])
                at += take
                if sum(map(len, points)) == POINTS:
                    yield tree()
                    ids, points = [], []
        if points:
            yield tree()

    return common.written(vectors.mapInArrow(run, TREES), "trees")


def each_tree(batches, dims: int):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].values, Tree.read(*(batch.column(j)[k].as_py() for j in range(1, 5)), dims)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of what is nearest to each; empty ones stay."""
    k, dims = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, tree in each_tree(batches, dims):
            n, s, _, _ = tree.nearest(centroids, False)
            counts += n
            sums += s
        some = np.flatnonzero(counts)
        each = np.concatenate([sums, counts[:, None]], axis=1)[some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(each.tolist(), pa.list_(pa.int64()))], names=["cluster", "s"])

    each = trees.mapInArrow(run, "cluster int, s array<long>").select("cluster", F.posexplode("s").alias("j", "x"))
    out = [[int(x) for x in row] for row in centroids]
    total = {(r["cluster"], r["j"]): int(r["x"]) for r in each.groupBy("cluster", "j").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()}
    for z in {z for z, _ in total}:
        out[z] = [total[z, j] // total[z, dims] for j in range(dims)]
    return np.array(out, np.int64).reshape(k, dims)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """A row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another length, null ones, and those with a null or non-finite component are left out.
    The first centroids are the kept vectors with the smallest SHA-256 of `seed:vec_id`, a null id
    last, of equal ids that with the smaller components; fewer vectors make fewer centroids, none an
    empty result. Repeated rows count as often as they come; ties go to the smaller number; other
    columns are not read. Components of 2**27 and more, scaled, are an error: their distances exceed
    a long, as would sums of distances beyond it.
    """
    spark = df.sparkSession
    common.prepare(spark)
    vectors = whole_vectors(df, id_col, vector_col, dims, scale)
    begin = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(centroids)
    now = np.array([r["v"] for r in begin.select("v").collect()], np.int64).reshape(-1, dims)
    if len(now) and np.abs(now).max() >= MOST:
        raise ValueError(f"components of {MOST} and more make distances that no long holds")
    trees = trees_of(vectors, dims)
    if len(now):
        for _ in range(rounds):
            now = moved(trees, now)

    def run(batches):
        for ids, tree in each_tree(batches, dims):
            _, _, label, distance = tree.nearest(now, True)
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = common.written(trees.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("x")).collect()}  # a row a centroid
    hashes = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in now.tolist()]
    rows = [(z, x, sum(sums.values()), hashes[z]) for z, x in sums.items()]
    if any(x >= 1 << 63 for _, _, x, _ in rows):
        raise ValueError("the distances' sum exceeds a long")
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def sql(dims: int = DIMS, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same clustering over the table embeddings: each round's distances to all centroids, in plain sums."""
    nearest = "SELECT vec_id, v, arg_min(z, d * {k} + z) AS z, min(d) AS d FROM (SELECT row, vec_id, v, z, CAST(list_sum(list_transform(list_zip(v, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS HUGEINT) AS d FROM kept, c{r}) GROUP BY row, vec_id, v".replace("{k}", str(centroids))
    parts = [f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS z, v AS c FROM kept
            ORDER BY sha256('{seed}:' || vec_id), v LIMIT {centroids})"""]
    for r in range(rounds):
        parts.append(f"""
        n{r} AS MATERIALIZED ({nearest.replace('{r}', str(r))}),
        m{r} AS MATERIALIZED (
            SELECT z, list(x ORDER BY j) AS m FROM (
                SELECT z, j, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
                FROM (SELECT z, unnest(v) AS x, unnest(range({dims})) AS j FROM n{r}) GROUP BY z, j) GROUP BY z),
        c{r + 1} AS MATERIALIZED (SELECT z, CASE WHEN m IS NULL THEN c ELSE CAST(m AS BIGINT[]) END AS c FROM c{r} LEFT JOIN m{r} USING (z))""")
    return f"""WITH {','.join(parts)},
        n AS MATERIALIZED ({nearest.replace('{r}', str(rounds))})
        SELECT n.vec_id, CAST(n.z AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance,
               CAST(sum(n.d) OVER (PARTITION BY n.z) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM n JOIN c{rounds} AS c USING (z)"""
