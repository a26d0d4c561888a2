"""Search: distances of query and base vectors, and what is kept of them.

All operators work on a table of distances D(query_id, vec_id, dist, ...), so
filters placed before ``distances`` are pre-filters and those after a top-k
are post-filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import METRICS
from ..sources.tables import new_path
from .nearest import MEASURES, best_rows, count_within, pairs_within

#: Query rows that may be broadcast; more are joined in blocks of as many.
MAX_BROADCAST_QUERIES = 4096


def pairs(queries: DataFrame, base: DataFrame, limit: int = MAX_BROADCAST_QUERIES, own: bool = True) -> DataFrame:
    """Every query with every base row, but rows of the query's id if not ``own``. The query side is broadcast if it is counted to be small, else dealt into blocks."""
    n = queries.limit(limit + 1).count()
    if n <= limit:
        both = base.join(F.broadcast(queries))
    else:
        blocks = -(-queries.count() // limit)
        q = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
        b = base.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        both = b.join(q, "_block").drop("_block")
    return both if own else both.filter(F.col("query_id") != F.col("vec_id"))


def distances(queries: DataFrame, base: DataFrame, metric: str | Callable[[Column, Column], Column] = "l2_sq", limit: int = MAX_BROADCAST_QUERIES, own: bool = True) -> DataFrame:
    """Adds ``dist`` to all pairs of queries (query_id, qvec, ...) and base (vec_id, vec, ...); NaN distances go."""
    f = METRICS[metric] if isinstance(metric, str) else metric
    return pairs(queries, base, limit, own).withColumn("dist", f(F.col("qvec"), F.col("vec"))).drop("qvec", "vec").filter(~F.isnan("dist"))


def top_k(d: DataFrame, k: int, by: str = "dist", rank: str = "rank", keys: tuple[str, ...] = ("query_id",), tie: str = "vec_id") -> DataFrame:
    """The k smallest of each group in the order (by, tie); Spark prunes each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).asc(), F.col(tie).asc())
    return d.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def knn(queries: DataFrame, base: DataFrame, k: int, metric="l2_sq", limit: int | None = None, own: bool = True) -> DataFrame:
    """Top k by distance, with the columns of both but their vectors. Metrics of ``MEASURES`` go by matrix products, others by all pairs."""
    if metric not in MEASURES:
        return top_k(distances(queries, base, metric, limit or MAX_BROADCAST_QUERIES, own), k)
    near = top_k(best_rows(queries.select("query_id", "qvec"), base, k, metric, own, limit=limit), k)
    more = queries.drop("qvec")
    return near.join(more, "query_id") if len(more.columns) > 1 else near


def knn_by_key(queries: DataFrame, base: DataFrame, k: int, key: Callable, own: bool = True) -> DataFrame:
    """Top k by a function of the distance that doesn't fall (such as ``nearest.rounded``), then by id; dist is the distance itself."""
    return top_k(best_rows(queries, base, k, own=own, key=key), k, by="key")


class Best:
    """The k nearest rows of each of some queries so far."""

    def __init__(self, query_ids: np.ndarray, k: int, own: bool = True):
        self.query_ids, self.k, self.own = query_ids, k, own
        self.dist, self.ids = np.full((len(query_ids), k), np.inf), np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, dist: np.ndarray) -> None:
        """Rows with their distances (query, row); ties go to the smaller id."""
        dist = np.where(np.isnan(dist), np.inf, dist)
        if not self.own:
            dist = np.where(self.query_ids[:, None] == ids[None], np.inf, dist)
        if len(ids) > self.k:  # all up to the k-th distance, so ties at it aren't lost
            kth = np.partition(dist, self.k - 1, axis=1)[:, self.k - 1]
            m = int((dist <= kth[:, None]).sum(axis=1).max())
            at = np.argpartition(dist, min(m, len(ids)) - 1, axis=1)[:, :m]
            dist, ids = np.take_along_axis(dist, at, 1), ids[at]
        both_d = np.hstack([self.dist, dist])
        both_i = np.hstack([self.ids, np.broadcast_to(ids, dist.shape)])
        at = np.lexsort((both_i, both_d), axis=1)[:, : self.k]
        self.dist, self.ids = np.take_along_axis(both_d, at, 1), np.take_along_axis(both_i, at, 1)

    def rows(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.dist))
        return pa.RecordBatch.from_arrays([pa.array(self.query_ids[i]), pa.array(self.ids[i, j]), pa.array(self.dist[i, j])], ["query_id", "vec_id", "dist"])


def scan(queries: DataFrame, rows: DataFrame, k: int, score: Callable, prepare: Callable = lambda q: q, limit: int = MAX_BROADCAST_QUERIES, own: bool = True) -> DataFrame:
    """Top k by numpy: ``score(prepare(query matrix), batch)`` gives distances (query, row). Each partition gives its own top k of each query.

    Queries are broadcast in blocks of at most about ``limit``; with more than one block, each block's answers are written before the next is read.
    """
    spark = rows.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // limit))

    def block(part: DataFrame) -> DataFrame:
        got = part.select("query_id", "qvec").limit(2 * limit).collect()
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in got], dtype=np.int64), np.array([r[1] for r in got], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            if not len(qid):
                return
            q, best = prepare(q), Best(qid, k, own)
            for b in batches:
                if b.num_rows:
                    best.add(b.column("vec_id").to_numpy(), score(q, b))
            yield best.rows()

        return top_k(rows.mapInArrow(run, "query_id bigint, vec_id bigint, dist double"), k)

    if blocks == 1:
        return block(queries)
    path = new_path(spark, "scan")
    for at in range(blocks):
        block(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """Lists of one length as a matrix of n rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def l2_by_product(q: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    x = matrix(batch.column("vec"), batch.num_rows).astype(np.float64)
    return np.maximum(np.square(q).sum(axis=1)[:, None] + np.square(x).sum(axis=1)[None] - 2 * q @ x.T, 0)


def knn_arrow(queries: DataFrame, base: DataFrame, k: int, limit: int = MAX_BROADCAST_QUERIES, own: bool = True) -> DataFrame:
    """Squared-L2 top-k by matrix products."""
    return scan(queries, base.select("vec_id", "vec"), k, l2_by_product, limit=limit, own=own)


def within(d: DataFrame, radius: float, inner: float | None = None) -> DataFrame:
    """inner < dist <= radius."""
    d = d.filter(F.col("dist") <= radius)
    return d if inner is None else d.filter(F.col("dist") > inner)


def diverse(queries: DataFrame, base: DataFrame, k: int, per_value: int, attribute: str, own: bool = True) -> DataFrame:
    """Top k with at most ``per_value`` rows of each attribute value; rows without one are dropped."""
    near = best_rows(queries, base.filter(F.col(attribute).isNotNull()), per_value, own=own, per=attribute)
    inner = top_k(near, per_value, rank="_r", keys=("query_id", attribute))
    return top_k(inner.drop("_r"), k)


def paged(ranked: DataFrame, page_size: int) -> DataFrame:
    """Non-overlapping pages of a ranking, numbered from 0."""
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / page_size).cast("bigint"))


def epsilon_stop(ranked: DataFrame, epsilon: float) -> DataFrame:
    """Rows of a ranking within epsilon."""
    return ranked.filter(F.col("dist") <= epsilon)


def without(base: DataFrame, gone: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """Rows whose vec_id isn't among those of ``gone``, which are broadcast if counted to be few, so vectors aren't shuffled."""
    few = gone.limit(limit + 1).count() <= limit
    return base.join(F.broadcast(gone) if few else gone, "vec_id", "left_anti")


def first_documents(queries: DataFrame, base: DataFrame, n_docs: int, doc: str, own: bool = True) -> DataFrame:
    """The n nearest documents, each by its nearest vector."""
    near = best_rows(queries, base, 1, own=own, per=doc)
    return top_k(near.groupBy("query_id", doc).agg(F.min("dist").alias("dist")), n_docs, tie=doc)


def beta_biased(queries: DataFrame, base: DataFrame, match: Column, beta: float, k: int, own: bool = True) -> DataFrame:
    """Rows that match are ordered by dist * beta, which is ``key``."""
    weighted = base.withColumn("_weight", F.when(match, float(beta)).otherwise(1.0))
    return top_k(best_rows(queries, weighted, k, own=own, weight="_weight"), k, by="key")


def adaptive_l(l_size: int, matches: Column, samples: Column, most: float) -> Column:
    """Search width from the share s of sampled rows that match: L * m, cut to a whole number, for m of 1, 2 or 2 ** -log10 s between 1 and ``most``; with no match m is ``most``."""
    s = matches / samples
    m = F.when(matches == 0, F.lit(float(most))).when(s >= 0.5, 1.0).when(s >= 0.1, 2.0).otherwise(F.pow(F.lit(2.0), -F.log10(s)))
    return F.floor(F.lit(float(l_size)) * F.greatest(F.lit(1.0), F.least(m, F.lit(float(most))))).cast("bigint")


def coarse_rerank(coarse: DataFrame, queries: DataFrame, base: DataFrame, c: int, k: int, metric: str | Callable[[Column, Column], Column] = "l2_sq") -> DataFrame:
    """Top c by coarse distance D(query_id, vec_id, dist), then top k of these by the exact distance of their own vectors."""
    f = METRICS[metric] if isinstance(metric, str) else metric
    kept = top_k(coarse, c, rank="coarse_rank").select("query_id", "vec_id", "coarse_rank")
    exact = kept.join(base.select("vec_id", "vec"), "vec_id").join(queries.select("query_id", "qvec"), "query_id").withColumn("dist", f(F.col("qvec"), F.col("vec"))).drop("qvec", "vec")
    return top_k(exact, k)


def range_two_phase(candidates: DataFrame, radius: float, l_size: int, slack: float = 1.0, inner: float | None = None, most: int | None = None) -> DataFrame:
    """Range search over candidates D(query_id, vec_id, dist) in two phases.

    The first phase looks at the ``l_size`` nearest of a query. Only if all of
    these lie within the radius, the second goes on, to all within radius *
    slack. What is within (inner, radius] is returned, at most ``most`` nearest.
    """
    if radius < 0 or slack < 1 or l_size < 1 or (inner is not None and inner > radius) or (most is not None and most < 1):
        raise ValueError("radius >= 0, slack >= 1, l_size >= 1, inner <= radius and most >= 1 are needed")
    w = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    numbered = candidates.withColumn("rank", F.row_number().over(w))
    full = numbered.filter((F.col("rank") == l_size) & (F.col("dist") <= radius)).select("query_id", F.lit(True).alias("more"))
    seen = numbered.join(full, "query_id", "left").filter((F.col("rank") <= l_size) | (F.col("more") & (F.col("dist") <= radius * slack)))
    kept = within(seen.drop("more", "rank"), radius, inner)
    return top_k(kept, most) if most is not None else kept


def early_stop(d: DataFrame, k: int, patience: int) -> DataFrame:
    """Top k of D(query_id, vec_id, dist, hop) when a query stops after ``patience`` hops in a row that gave nothing nearer than its k-th so far."""
    hops = d.groupBy("query_id", "hop").agg(F.array_sort(F.collect_list("dist")).alias("near"))
    before = Window.partitionBy("query_id").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
    so_far = hops.withColumn("seen", F.array_sort(F.flatten(F.collect_list(F.slice("near", 1, k)).over(before))))
    better = so_far.withColumn("better", F.coalesce(F.col("near")[0] < F.get("seen", F.lit(k - 1)), F.lit(True)))
    # how many hops since one that helped
    upto = Window.partitionBy("query_id").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    stale = better.withColumn("stale", F.col("hop") - F.max(F.when(F.col("better"), F.col("hop"))).over(upto))
    stop = stale.filter(F.col("stale") >= patience).groupBy("query_id").agg(F.min("hop").alias("stop"))
    return top_k(d.join(stop, "query_id", "left").filter(F.col("stop").isNull() | (F.col("hop") <= F.col("stop"))).drop("stop"), k)


def multi_vector(tokens_d: DataFrame, how: str) -> DataFrame:
    """(query_id, doc, value) from token distances D(query_id, qtok, doc, dtok, dist).

    chamfer: sum over query tokens of the nearest; average_pairwise; min_pairwise; average_of_mins.
    """
    if how in ("average_pairwise", "min_pairwise"):
        return tokens_d.groupBy("query_id", "doc").agg((F.avg if how[0] == "a" else F.min)("dist").alias("value"))
    nearest = tokens_d.groupBy("query_id", "doc", "qtok").agg(F.min("dist").alias("m"))
    return nearest.groupBy("query_id", "doc").agg((F.sum if how == "chamfer" else F.avg)("m").alias("value"))
