"""Approximate nearest neighbours by multiprobe p-stable hashing.

``TABLES`` tables of ``HASHES`` Gaussian projections, cut into slots of width
``WIDTH`` times the data's scale; the slots of a row are its bucket in each
table. A neighbour at distance r lands some slots off with a probability that
the normal distribution gives, so each bucket has an estimated success for a
query. A query visits the perturbed buckets in falling order of success, down
to a share of its best bucket's. That share comes from a bounded sample of
queries with exact neighbours (one scan): the one at which ``TARGET`` of them
are found.

Buckets are tables of rows. The first slots of a bucket are its region, as many
that there are about as many regions as ``SHARD`` goes into the rows. Each row
goes to its region in every table, and a query to the regions in which it
visits buckets; no row is copied per block of queries, but in regions that more
than ``BLOCK`` queries visit. Regions of more than ``SHARD`` rows are dealt out
in parts by a hash, so a hot bucket is many tasks of bounded size. Within a
task only rows of visited buckets get distances. Each task returns its best
rows of a query; tables are merged, and the best get ranks.

Rows of one vector are one class with its k + 1 smallest ids, found before
anything is dealt out, so copies are neither compared with each other nor fill
a region. A class that finds fewer than k neighbours though there are more (its
buckets are nearly empty) visits all buckets of one table.

Defined results: null, zero and non-finite vectors, and those with null
components, take no part; vectors of different dimension are never neighbours;
fewer than k candidates give fewer rows; ties go to the smaller vec_id; rows
with the same vec_id and vector count once, rows with one vec_id and different
vectors are candidates of their own but never of their own id, and as queries
each gets its rows; an empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, stage_table, table

K = 10
TABLES, HASHES, WIDTH = 4, 8, 1.2
TARGET = 0.95
#: Rows and queries of a task, vectors that the scale is learned from, and queries that the threshold is learned from.
SHARD, BLOCK, SAMPLE, PROBES = 8192, 2048, 2048, 64
#: Slots end here on both sides; the last ones hold all that lies beyond, so outliers don't widen the tables.
EDGE = 3
SLOTS = 2 * EDGE + 1
SEED = 20

CLASS = "h long, lead long, ids array<long>, embedding array<double>"
FOUND = "h long, lead long, score double, ids array<long>, of_h long, of_lead long, compared long"


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


class Hashes:
    """The projections of one dimension, and the estimated success of buckets."""

    def __init__(self, dim: int, scale: float):
        rng = np.random.default_rng((SEED, dim))
        self.dim = dim
        self.planes = rng.standard_normal((TABLES, dim, HASHES))
        self.shift = rng.uniform(0, 1, (TABLES, 1, HASHES))
        self.width = max(WIDTH * scale, 1e-12)
        self.radius, self.reach = self.width, 0.0
        self.region_slots = 1

    def places(self, x: np.ndarray) -> np.ndarray:
        """(table, row, hash): position in slots."""
        return np.matmul(x[None], self.planes) / self.width + self.shift

    def slots(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(np.floor(self.places(x)), -EDGE, EDGE) + EDGE).astype(np.int64)

    def losses(self, places: np.ndarray) -> np.ndarray:
        """(..., hash, slot): log of the best slot's success over this slot's, for queries at ``places``."""
        spread = max(self.radius / self.width, 1e-9)
        edges = (np.arange(-EDGE, EDGE + 2) - np.clip(places, -1e6, 1e6)[..., None]) / spread
        edges[..., 0], edges[..., -1] = -np.inf, np.inf
        cdf = 0.5 * (1 + np.vectorize(erf)(edges / 2**0.5))
        logs = np.log(np.maximum(np.diff(cdf, axis=-1), 1e-300))
        return logs.max(axis=-1, keepdims=True) - logs

    def fit(self, queries: np.ndarray, neighbours: list[np.ndarray], rows: int, shard_rows: int) -> None:
        """Radius, and the loss down to which queries visit buckets, from exact neighbours of some queries."""
        far = [np.sqrt(np.square(n - q).sum(axis=1)) for q, n in zip(queries, neighbours, strict=True) if len(n)]
        if far:
            self.radius = max(float(np.median(np.concatenate(far))), 1e-9 * self.width)
            lost = []
            for q, near in zip(queries, neighbours, strict=True):
                if len(near):
                    loss, slots = self.losses(self.places(q[None])[:, 0]), self.slots(near)
                    each = sum(np.take_along_axis(loss[:, h], slots[:, :, h], axis=1) for h in range(HASHES))
                    lost.append(each.min(axis=0))
            self.reach = float(np.quantile(np.concatenate(lost), TARGET)) + 1e-9
        regions = max(1.0, rows / shard_rows)
        self.region_slots = int(min(HASHES, max(1, np.ceil(np.log(regions) / np.log(4)))))

    def regions(self, slots: np.ndarray) -> np.ndarray:
        code = np.zeros(slots.shape[:-1], dtype=np.int64)
        for h in range(self.region_slots):
            code = code * SLOTS + slots[..., h]
        return code

    def visited_regions(self, loss: np.ndarray) -> np.ndarray:
        """Regions in which a query of one table, with losses (hash, slot), visits buckets; the best first."""
        code, total = np.zeros(1, dtype=np.int64), np.zeros(1)
        for h in range(self.region_slots):
            total = (total[:, None] + loss[h][None]).ravel()
            code = (code[:, None] * SLOTS + np.arange(SLOTS)[None]).ravel()
            code, total = code[total <= self.reach], total[total <= self.reach]
        return code[np.argsort(total, kind="stable")]


def search_region(hashes: Hashes, t: int, x: np.ndarray, q: np.ndarray, every: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each query its best k rows, their distances, and how many were compared: those in buckets that it visits."""
    slots = hashes.slots(x)[t]
    buckets, home = np.unique(slots, axis=0, return_inverse=True)
    order = np.argsort(home.ravel(), kind="stable")
    sizes = np.bincount(home.ravel(), minlength=len(buckets))
    loss = hashes.losses(hashes.places(q)[t])
    norms = np.square(x).sum(axis=1)
    out = []
    for i in range(len(q)):
        total = np.zeros(len(buckets))
        for h in range(HASHES):
            total += loss[i, h][buckets[:, h]]
        at = order[np.repeat(every[i] | (total <= hashes.reach), sizes)]
        compared = len(at)
        if compared > k:
            # a product finds what may be among the best k; these get their exact distances
            guess = norms[at] - 2 * (x[at] @ q[i])
            kth = np.partition(guess, k - 1)[k - 1]
            at = at[guess <= kth + 1e-9 * (1 + abs(kth) + np.square(q[i]).sum())]
        # the sum runs over dimensions in order, as plain double arithmetic does
        d = np.sqrt(np.square(x[at] - q[i]).cumsum(axis=1)[:, -1]) if compared else np.empty(0)
        out.append((at, d, compared))
    return out


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """CLASS: one row for each vector, with its k + 1 smallest ids, the first being its lead."""
    once = vectors.groupBy("vec_id", "embedding").agg(F.xxhash64("embedding").alias("h"))
    first = Window.partitionBy("h", "embedding").orderBy("vec_id")
    few = once.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    grouped = few.groupBy("h", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return grouped.select("h", F.col("ids")[0].alias("lead"), "ids", "embedding")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit_hashes(classes: DataFrame, k: int = K, shard_rows: int = SHARD) -> dict[int, Hashes]:
    """The hashes of each dimension. About ``SAMPLE`` vectors of each, and k neighbours of ``PROBES`` of them in each partition, leave the executors."""
    dim = F.size("embedding")
    counts = {r["dim"]: r["n"] for r in classes.groupBy(dim.alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted = {}
    for d, n in counts.items():
        chance = F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / n) * (1 << 30))
        rows = classes.filter((dim == d) & chance).select("h", "embedding").limit(2 * SAMPLE).collect()
        x = np.array([r["embedding"] for r in sorted(rows, key=lambda r: (r["h"], r["embedding"]))], dtype=np.float64).reshape(-1, d)
        if not len(x):
            x = np.array([classes.filter(dim == d).first()["embedding"]], dtype=np.float64)
        scale = float(np.sqrt(np.mean(np.var(x, axis=0)) * d)) if len(x) > 1 else 1.0
        hashes = Hashes(d, scale or 1.0)
        queries = x[:PROBES]

        def nearest_rows(batches, queries=queries, d=d):
            best, where = np.full((len(queries), k + 1), np.inf), np.zeros((len(queries), k + 1, d))
            for batch in batches:
                for at in range(0, batch.num_rows, SHARD):
                    y = matrix(batch.column(0).slice(at, SHARD), d)
                    far = np.square(queries).sum(1)[:, None] + np.square(y).sum(1)[None] - 2 * queries @ y.T
                    both, rows = np.hstack([best, far]), np.argsort(np.hstack([best, far]), axis=1, kind="stable")[:, : k + 1]
                    best = np.take_along_axis(both, rows, axis=1)
                    where = np.stack([np.vstack([where[i], y])[rows[i]] if (rows[i] > k).any() else where[i][rows[i]] for i in range(len(queries))])
            i, j = np.nonzero(np.isfinite(best))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(best[i, j]), pa.array(list(where[i, j]), pa.list_(pa.float64()))], ["q", "far", "embedding"])

        found = map_arrow(classes.filter(dim == d).select("embedding"), nearest_rows, "q long, far double, embedding array<double>")
        best = Window.partitionBy("q").orderBy("far", "embedding")
        near: list[list] = [[] for _ in queries]
        for r in found.withColumn("r", F.row_number().over(best)).filter(F.col("r").between(2, k + 1)).collect():  # the first is the query itself
            near[r["q"]].append(r["embedding"])
        hashes.fit(queries, [np.array(v, dtype=np.float64).reshape(-1, d) for v in near], n, shard_rows)
        fitted[d] = hashes
    return fitted


def search_classes(classes: DataFrame, queries: DataFrame, fitted: dict[int, Hashes], k: int, every: bool, shard_rows: int, block_rows: int) -> DataFrame:
    """FOUND: of each class of ``queries`` its best k + 1 classes in each task, itself included. With ``every``, all buckets of the first table are visited."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(fitted)
    tables = 1 if every else TABLES

    def placed(batches):
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                hashes = shared.value[int(d)]
                region = hashes.regions(hashes.slots(matrix(part.column("embedding"), d)))[:tables]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), t)), pa.array(region[t]), *part.columns], ["t", "region", *part.schema.names])

    def visiting(batches):
        for batch in batches:
            rows, at_t, at_region = [], [], []
            for i, v in enumerate(batch.column("embedding").to_pylist()):
                hashes = shared.value[len(v)]
                loss = hashes.losses(hashes.places(np.array([v]))[:, 0])
                for t in range(tables):
                    some = hashes.visited_regions(loss[t])
                    rows += [i] * len(some)
                    at_t += [t] * len(some)
                    at_region += some.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(at_t, pa.int64()), pa.array(at_region, pa.int64()), *batch.take(pa.array(rows, pa.int64())).columns], ["t", "region", *batch.schema.names])

    key = ["dim", "t", "region"]
    kind = f"t long, region long, {CLASS}"
    rows = map_arrow(classes, placed, kind).withColumn("dim", F.size("embedding"))
    n_rows = stage_table(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "regions")
    if every:
        asked = queries.withColumn("dim", F.size("embedding")).join(n_rows.select(*key), "dim")
    else:
        asked = map_arrow(queries, visiting, kind).withColumn("dim", F.size("embedding"))
    n_asked = asked.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    parts = stage_table(n_rows.join(n_asked, key).select(*key, F.ceil(F.col("n") / shard_rows).alias("parts"), F.ceil(F.col("m") / block_rows).alias("blocks")), "parts")
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "h", "lead"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    # rows of regions that no query visits go no further
    left = rows.join(parts, key).withColumn("part", deal(1, "parts")).withColumn("block", each("blocks")).withColumn("query", F.lit(False))
    right = asked.join(parts, key).withColumn("block", deal(2, "blocks")).withColumn("part", each("parts")).withColumn("query", F.lit(True))
    columns = [*key, "part", "block", "query", "h", "lead", "ids", "embedding"]
    schema = pa.schema([("h", pa.int64()), ("lead", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64())), ("of_h", pa.int64()), ("of_lead", pa.int64()), ("compared", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        query = group.column("query").combine_chunks().to_numpy(zero_copy_only=False)
        if not query.any() or query.all():
            return schema.empty_table()
        asked, base = group.filter(pa.array(query)), group.filter(pa.array(~query))
        dim, t = group.column("dim")[0].as_py(), group.column("t")[0].as_py()
        found = search_region(shared.value[dim], t, matrix(base.column("embedding"), dim), matrix(asked.column("embedding"), dim), np.full(len(asked), every), k + 1)
        at = np.concatenate([f[0] for f in found])
        who = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        score = np.concatenate([f[1] for f in found])
        # what was compared stands at a query's first row
        first = np.append(True, who[1:] != who[:-1]) if len(who) else np.empty(0, dtype=bool)
        compared = np.where(first, np.array([f[2] for f in found])[who], 0)
        near, of = base.take(pa.array(at)), asked.take(pa.array(who))
        return pa.Table.from_arrays([near.column("h"), near.column("lead"), pa.array(score), near.column("ids"), of.column("h"), of.column("lead"), pa.array(compared)], schema=schema)

    tasks = left.select(*columns).unionByName(right.select(*columns))
    return stage_table(tasks.groupBy(*key, "part", "block").applyInArrow(run, FOUND), "found")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(of_h, of_lead, near): for each class of queries the (score, vec_id) of its nearest classes' ids, nearest first."""
    merged = found.groupBy("of_h", "of_lead", "h", "lead", "ids").agg(F.min("score").alias("score"))
    order = Window.partitionBy("of_h", "of_lead").orderBy("score", "lead", "h")
    best = merged.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    rows = F.transform("ids", lambda i: F.struct("score", i.alias("vec_id")))
    return best.groupBy("of_h", "of_lead").agg(F.array_sort(F.flatten(F.collect_list(rows))).alias("near"))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score, n_compared for rows of (vec_id, embedding); every row is indexed.

    ``n_compared`` is how many distances were computed for the query's vector, over all tables.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("query"))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    classes = stage_table(classes_of(vectors, k), "vectors")
    fitted = fit_hashes(classes, k, shard_rows)
    # ids of queries with the class of their vector
    asking = stage_table(vectors.filter("query").select("vec_id", "embedding").distinct().withColumn("h", F.xxhash64("embedding")).join(classes.select("h", "embedding", "lead"), ["h", "embedding"]).select("vec_id", "h", "lead"), "queries")
    of = asking.select("h", "lead").distinct()
    queries = stage_table(classes.join(of, ["h", "lead"], "left_semi"), "asked")
    found = search_classes(classes, queries, fitted, k, False, shard_rows, block_rows)
    near = stage_table(best_of(found, k), "near")
    # a class is short if it has fewer ids than k + 1 and than there are
    ids = classes.groupBy(F.size("embedding").alias("dim")).agg(F.sum(F.size("ids")).alias("n_ids"))
    have = near.select(F.col("of_h").alias("h"), F.col("of_lead").alias("lead"), F.size("near").alias("have"))
    short = queries.withColumn("dim", F.size("embedding")).join(ids, "dim").join(have, ["h", "lead"], "left")
    short = stage_table(short.filter(F.coalesce("have", F.lit(0)) < F.least(F.lit(k + 1), F.col("n_ids"))).select("h", "lead", "ids", "embedding"), "short")
    if not short.isEmpty():
        more = search_classes(classes, short, fitted, k, True, shard_rows, block_rows)
        found = found.unionByName(more)
        near = stage_table(best_of(found, k), "near")
    compared = found.groupBy("of_h", "of_lead").agg(F.sum("compared").alias("n_compared"))
    near = near.join(compared, ["of_h", "of_lead"]).withColumnsRenamed({"of_h": "h", "of_lead": "lead"})
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = asking.withColumnRenamed("vec_id", "query_id").join(near, ["h", "lead"]).select("query_id", "n_compared", F.posexplode(others).alias("at", "x"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"), "n_compared")


def op3_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
