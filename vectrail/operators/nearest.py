"""Exact nearest rows by matrix products.

A product of query and row matrices in single precision gives a lower bound of
each distance, wide enough for its own rounding; tiles with numbers that single
precision can't hold are multiplied in double. Only pairs whose bound is not
above what a query has already found get their distance, summed left to right
in double precision as the Column metrics do, so results and ties are those of
a full scan. Each partition gives its own best rows; Spark ranks these.

Vectors that are null, hold nulls, or have another length than the query's take
no part, nor do rows without an id or pairs whose distance is NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import MIN_NORM
from ..sources.tables import new_path

#: Results that a partition holds for the queries of one broadcast; queries and rows of one product; pairs whose distances are summed at once; partitions of a table that one task scans.
HELD, QUERIES, ROWS, PAIRS, JOINED = 1 << 20, 1024, 2048, 32768, 4
#: Squared norms up to here can be multiplied in single precision.
PLAIN = 1e30


def total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, left to right."""
    return np.cumsum(x, axis=1)[:, -1] + 0 if x.shape[1] else np.zeros(len(x), dtype=x.dtype)


def _ip(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return total(a * b)


def _l2_sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return total(np.square(a - b))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.sqrt(_ip(a, a)), np.sqrt(_ip(b, b))
    # as in SQL, where NaN is the largest number, least() makes 1 of it
    return 1 - np.where((na < MIN_NORM) | (nb < MIN_NORM), 0.0, np.fmax(-1.0, np.fmin(1.0, _ip(a, b) / (na * nb))))


#: Distances of pairs by name; for the product: whether vectors are scaled to norm 1, the product's factor, what is added, whether squares are, and what is applied to the whole (it may not fall).
MEASURES: dict[str, tuple[Callable, bool, float, float, bool, Callable | None]] = {
    "l2_sq": (_l2_sq, False, -2.0, 0.0, True, None),
    "l2": (lambda a, b: np.sqrt(_l2_sq(a, b)), False, -2.0, 0.0, True, lambda x: np.sqrt(np.maximum(x, 0))),
    "int_l2_sq": (_l2_sq, False, -2.0, 0.0, True, None),
    "ip": (_ip, False, 1.0, 0.0, False, None),
    "ip_score": (lambda a, b: -_ip(a, b), False, -1.0, 0.0, False, None),
    "ip_distance": (lambda a, b: 1 - _ip(a, b), False, -1.0, 1.0, False, None),
    "cosine": (_cosine, True, -1.0, 1.0, False, None),
    "cosine_normalized": (lambda a, b: 1 - _ip(a, b), False, -1.0, 1.0, False, None),
}


def rounded(digits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Halves away from zero, as SQL's round."""
    scale = 10.0**digits

    def f(x: np.ndarray) -> np.ndarray:
        y = np.abs(x) * scale
        low = np.floor(y)
        return np.where(np.isfinite(y), np.copysign(low + (y - low >= 0.5), x) / scale, x)

    return f


def dense(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the lists of each length; null lists and lists with nulls are left out."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    ok = sizes >= 0
    begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    if flat.null_count:
        owner = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
        ok[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = False
        flat = flat.fill_null(0)
    flat = flat.to_numpy(zero_copy_only=False)
    flat = flat if flat.dtype == np.float32 and kind == np.float64 else flat.astype(kind)
    for size in np.unique(sizes[ok]):
        at = np.flatnonzero(ok & (sizes == size))
        yield at, flat.reshape(-1, size) if len(at) * size == len(flat) and size else flat[begin[at][:, None] + np.arange(size)]


class Side:
    """Vectors of one length with what the bounds need: ``plus`` has two columns more, whose product with the other side's adds what doesn't depend on the pair.

    ``weight`` (of rows) multiplies the bounds.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, measure: str, is_query: bool, weight: np.ndarray | None = None):
        self.ids, self.x, self.measure, self.is_query, self.weight = ids, x, measure, is_query, weight
        self.plus, self.slack, n = self.bounds(slice(None), np.float32)
        self.plain = n < PLAIN if weight is None else (n < PLAIN) & (weight < PLAIN) & (n * weight < PLAIN)

    def bounds(self, part: slice, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """plus and slack of these vectors for a product of this type, and their squared norms."""
        _, unit, factor, add, squares, _ = MEASURES[self.measure]
        with np.errstate(all="ignore"):
            v = self.x[part].astype(np.float64)
            n = norms = np.square(v).sum(axis=1)
            if unit:
                norm = np.sqrt(n)[:, None]
                v, n = np.where(norm < MIN_NORM, 0.0, v / norm), np.ones(len(v))
            # beyond all rounding of the numbers, of the product and of the sums; the last number is for what underflows
            wide = (2 if kind == np.float32 else 8) * (v.shape[1] + 16) * float(np.finfo(kind).eps)
            slack = wide * (n + 0.5 * (1e-30 + abs(add)))
            part_of_all = n * squares - slack + (add if self.is_query else 0)
            one = np.ones(len(v))
            plus = np.column_stack([v * factor, part_of_all, one] if self.is_query else [v, one, part_of_all])
            if self.weight is not None:
                plus *= self.weight[part][:, None]
            return plus.astype(kind, copy=False), slack, norms


class Bounds:
    """Lower bounds of the distances of two sides, tile by tile, in memory that is used again."""

    def __init__(self) -> None:
        self.room = np.empty(QUERIES * ROWS, dtype=np.float32)

    def of(self, q: Side, part: slice, x: Side, tile: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bounds, and the slack of both sides; these hold until the next call."""
        if q.plain[part].all() and x.plain[tile].all():
            a, b = q.plus[part], x.plus[tile]
            return np.matmul(a, b.T, out=self.room[: len(a) * len(b)].reshape(len(a), len(b))), q.slack[part], x.slack[tile]
        (a, s, _), (b, t, _) = q.bounds(part, np.float64), x.bounds(tile, np.float64)
        return a @ b.T, s, t


def up(x: np.ndarray, kind: type) -> np.ndarray:
    """x as this type, not below it."""
    return x if kind == np.float64 else np.nextafter(x.astype(kind), kind(np.inf))


def places(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of what is true."""
    return np.divmod(np.flatnonzero(keep), keep.shape[1])


class Nearest:
    """The k best rows of each query of one length, by ``key`` of their weighted distance and then by id."""

    def __init__(self, queries: Side, k: int, measure: str, own: bool, key: Callable | None):
        self.q, self.k, self.own, self.key = queries, k, own, key
        self.of, *_, self.after = MEASURES[measure]
        n = len(queries.ids)
        self.keys, self.ids = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.dist, self.rows = np.zeros((n, k), dtype=np.int64 if measure == "int_l2_sq" else np.float64), np.full((n, k), -1)
        self.bounds = Bounds()

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """What weighted distances, or bounds of them, are ranked by."""
        return x if self.key is None else self.key(x)

    def add(self, x: Side, rows: np.ndarray) -> None:
        for at in range(0, len(self.q.ids), QUERIES):
            for a in range(0, len(x.ids), ROWS):
                with np.errstate(all="ignore"):
                    self.tile(slice(at, at + QUERIES), x, slice(a, a + ROWS), rows)

    def tile(self, part: slice, x: Side, tile: slice, rows: np.ndarray) -> None:
        ids, w = x.ids[tile], None if x.weight is None else x.weight[tile]
        rank = lambda b: self.ranked(self.after(b) if self.after else b)
        low, slack, more = self.bounds.of(self.q, part, x, tile)
        full = self.rows[part, -1] >= 0
        most = np.where(full, self.keys[part, -1], np.inf)
        few = np.flatnonzero(~full)
        if len(few) and len(ids) > self.k:  # the k-th of what these rows can have at most
            wide = 2 * (slack[few][:, None] + more[None])
            high = rank(low[few] + (wide if w is None else wide * w))
            # a row without a finite bound may have a distance that doesn't count
            high[~np.isfinite(high)] = np.inf
            high[:, ~np.isfinite(more)] = np.inf
            if not self.own:
                high[self.q.ids[part][few][:, None] == ids[None]] = np.inf
            most[few] = np.partition(high, self.k - 1, axis=1)[:, self.k - 1]
        near = np.flatnonzero(~(rank(low.min(axis=1).astype(np.float64)) > most))
        if not len(near):
            return
        low, most = low if len(near) == len(low) else low[near], most[near][:, None]
        if self.after or self.key:
            low = rank(low.astype(np.float64))
            keep = ~(low > most)
            if self.key:  # equal ones of larger ids come after what is full
                keep &= ~((low == most) & full[near][:, None] & (ids[None] > self.ids[part, -1][near][:, None]))
        else:
            keep = ~(low > up(most, low.dtype.type))
        i, j = places(keep)
        i = near[i]
        if not self.own:
            other = self.q.ids[part][i] != ids[j]
            i, j = i[other], j[other]
        if not len(i):
            return
        i, j = i + part.start, j + tile.start
        dist = distances_of(self.of, self.q.x, x.x, i, j)
        key = self.ranked(dist if x.weight is None else dist * x.weight[j]).astype(np.float64)
        some = ~np.isnan(key)
        self.merge(i[some], key[some], x.ids[j[some]], dist[some], rows[j[some]])

    def merge(self, i: np.ndarray, key: np.ndarray, ids: np.ndarray, dist: np.ndarray, rows: np.ndarray) -> None:
        touched = np.unique(i)
        held = self.rows[touched] >= 0
        q = np.concatenate([np.repeat(touched, self.k).reshape(-1, self.k)[held], i])
        key, ids, dist, rows = (np.concatenate([have[touched][held], new]) for have, new in ((self.keys, key), (self.ids, ids), (self.dist, dist), (self.rows, rows)))
        at = np.lexsort((ids, key, q))
        q = q[at]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        best = place < self.k
        at, to = at[best], (q[best], place[best])
        self.keys[to], self.ids[to], self.dist[to], self.rows[to] = key[at], ids[at], dist[at], rows[at]

    def found(self) -> tuple[np.ndarray, ...]:
        i, j = np.nonzero(self.rows >= 0)
        return self.q.ids[i], self.ids[i, j], self.dist[i, j], self.keys[i, j], self.rows[i, j]


def distances_of(of: Callable, q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    kind = np.int64 if x.dtype == np.int64 else np.float64
    return np.concatenate([of(q[i[a : a + PAIRS]].astype(kind, copy=False), x[j[a : a + PAIRS]].astype(kind, copy=False)) for a in range(0, len(i), PAIRS)])


def spread(rows: DataFrame) -> DataFrame:
    """Rows of few partitions, such as a single file's, dealt to all cores; many partitions joined, as a task finds less anew the more rows it has seen."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    now = rows.rdd.getNumPartitions()
    if now < n:
        return rows.repartition(n)
    return rows.coalesce(min(now, n * -(-now // (JOINED * n))))


def _over_blocks(queries: DataFrame, limit: int, measure: str, run: Callable[[object, type], DataFrame]) -> DataFrame:
    """``run`` of a broadcast of sides by length for each block of queries; with more than one block, each block's answers are written before the next is read."""
    spark = queries.sparkSession
    kind = np.int64 if measure == "int_l2_sq" else np.float64
    blocks = max(1, -(-queries.count() // limit))

    def block(some: DataFrame) -> DataFrame:
        got = some.select("query_id", "qvec").toArrow().combine_chunks()
        sides = {}
        if got.num_rows:
            ids = got.column("query_id").chunk(0).to_numpy(zero_copy_only=False)
            sides = {x.shape[1]: Side(ids[at], x, measure, True) for at, x in dense(got.column("qvec").chunk(0), kind)}
        return run(spark.sparkContext.broadcast(sides), kind)

    if blocks == 1:
        return block(queries)
    path = new_path(spark, "nearest")
    for at in range(blocks):
        block(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def best_rows(queries: DataFrame, base: DataFrame, k: int, measure: str = "l2_sq", own: bool = True, key: Callable | None = None, weight: str | None = None, per: str | None = None, limit: int | None = None) -> DataFrame:
    """query_id, the columns of ``base`` but vec, dist (and key): at least the k best rows of each query, or of each query and value of ``per``; ``own`` is whether rows of the query's id take part.

    Best are the smallest of dist, of dist * ``weight`` (a column of base, not
    negative), or of ``key``, a function that doesn't fall, of these; equal
    ones by vec_id. Each partition gives its own k, for a ``top_k`` to rank.
    """
    if weight and MEASURES[measure][-1]:
        raise ValueError(f"no weights of {measure}")
    keyed = key is not None or weight is not None
    extra = [f for f in base.schema.fields if f.name not in ("vec_id", "vec", weight)]
    number = T.LongType() if measure == "int_l2_sq" else T.DoubleType()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), *extra, T.StructField("dist", number), *([T.StructField("key", T.DoubleType())] if keyed else [])])
    names = [f.name for f in extra]
    rows = spread(base.filter("vec_id is not null"))

    def run(shared, kind: type) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states: dict[tuple, Nearest] = {}
            kept, n = [], 0
            for b in batches:
                if not b.num_rows:
                    continue
                ids, w = b.column("vec_id").to_numpy(), b.column(weight).to_numpy(zero_copy_only=False) if weight else None
                kept.append(b.select(names))
                values, value = [None], np.zeros(b.num_rows, dtype=np.int64)
                if per:
                    told = b.column(per).dictionary_encode("encode")
                    values, value = told.dictionary.to_pylist(), told.indices.to_numpy(zero_copy_only=False)
                for at, x in dense(b.column("vec"), kind):
                    if x.shape[1] not in shared.value:
                        continue
                    for v, name in enumerate(values):
                        pick = value[at] == v
                        where = at[pick]
                        if len(where):
                            state = states.setdefault((name, x.shape[1]), None) or Nearest(shared.value[x.shape[1]], k, measure, own, key)
                            states[name, x.shape[1]] = state
                            state.add(Side(ids[where], x[pick], measure, False, None if w is None else w[where]), where + n)
                n += b.num_rows
            for state in states.values():
                q, ids, dist, keys, at = state.found()
                more = pa.Table.from_batches(kept).take(pa.array(at)).combine_chunks() if names and len(at) else None
                columns = [pa.array(q), pa.array(ids), *((more.column(c).chunk(0) if more is not None else pa.nulls(0, kept[0].schema.field(c).type)) for c in names), pa.array(dist), *([pa.array(keys)] if keyed else [])]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

        return rows.mapInArrow(scan, schema)

    return _over_blocks(queries, limit or max(1, HELD // (16 * k if per else k)), measure, run)


def pairs_within(queries: DataFrame, base: DataFrame, radius: float, measure: str = "l2_sq", own: bool = True, limit: int | None = None) -> DataFrame:
    """(query_id, vec_id, dist) of all pairs up to the radius."""
    def found(sides: dict, b: pa.RecordBatch, kind: type) -> Iterator[pa.RecordBatch]:
        for q, side, i, j, _ in _within(sides, b, kind, radius, measure, own, False):
            if not len(i):
                continue
            dist = distances_of(MEASURES[measure][0], q.x, side.x, i, j)
            some = dist <= radius
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[i[some]]), pa.array(side.ids[j[some]]), pa.array(dist[some].astype(np.float64))], ["query_id", "vec_id", "dist"])

    rows = spread(base.filter("vec_id is not null").select("vec_id", "vec"))
    run = lambda shared, kind: rows.mapInArrow(lambda batches: (out for b in batches for out in found(shared.value, b, kind)), "query_id bigint, vec_id bigint, dist double")
    return _over_blocks(queries, limit or HELD // 16, measure, run)


def count_within(queries: DataFrame, base: DataFrame, radius: float, measure: str = "l2_sq", own: bool = True, limit: int | None = None) -> DataFrame:
    """One row, n: how many pairs ``pairs_within`` has. Only pairs whose bounds don't tell get their distance."""

    def counted(sides: dict, batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for q, side, i, j, sure in _within(sides, b, kind, radius, measure, own, True):
                n += sure + (int((distances_of(MEASURES[measure][0], q.x, side.x, i, j) <= radius).sum()) if len(i) else 0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = spread(base.filter("vec_id is not null").select("vec_id", "vec"))
    run = lambda shared, kind: rows.mapInArrow(lambda batches: counted(shared.value, batches, kind), "n bigint")
    return _over_blocks(queries, limit or HELD // 8, measure, run).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))


def _within(sides: dict, b: pa.RecordBatch, kind: type, radius: float, measure: str, own: bool, count: bool) -> Iterator[tuple]:
    """(queries, rows, i, j, sure) by tiles: pairs that may lie within the radius; with ``count``, how many surely do and only the rest as pairs."""
    after, bounds, ids = MEASURES[measure][-1], Bounds(), b.column("vec_id").to_numpy()
    for at, x in dense(b.column("vec"), kind):
        q = sides.get(x.shape[1])
        if q is None:
            continue
        side = Side(ids[at], x, measure, False)
        for lo in range(0, len(q.ids), QUERIES):
            for a in range(0, len(side.ids), ROWS):
                part, tile = slice(lo, lo + QUERIES), slice(a, a + ROWS)
                with np.errstate(all="ignore"):
                    low, slack, more = bounds.of(q, part, side, tile)
                    if not own:
                        mine = np.flatnonzero(np.isin(side.ids[tile], q.ids[part]))
                        same, column = np.nonzero(q.ids[part][:, None] == side.ids[tile][mine][None])
                        low[same, mine[column]] = np.inf
                    if count and not after and low.dtype == np.float32:
                        # at most this far above its bound is a distance
                        inside = low < -up(np.array(-(radius - 2 * (slack.max() + more.max()))), np.float32)
                        sure = int(np.count_nonzero(inside))
                        keep = ~(low > up(np.array(radius), np.float32)) ^ inside
                    else:
                        sure, keep = 0, ~((after(low.astype(np.float64)) if after else low) > up(np.array(radius), np.float64 if after else low.dtype.type))
                    i, j = places(keep)
                    if not own:  # of those without a bound
                        other = q.ids[part][i] != side.ids[tile][j]
                        i, j = i[other], j[other]
                    yield q, side, i + lo, j + a, sure
