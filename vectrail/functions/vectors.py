"""Metrics over ARRAY columns as Column expressions; sums run left to right in double precision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Norms below the smallest normal 32-bit float count as zero in cosine similarity.
MIN_NORM = 1.17549435e-38


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def ip(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_sq(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_sq(a, b))


def ip_score(a: Column, b: Column) -> Column:
    """Inner product, negated: lower is better."""
    return -ip(a, b)


def ip_distance(a: Column, b: Column) -> Column:
    return 1 - ip(a, b)


def l1_norm(a: Column) -> Column:
    return total(F.transform(doubles(a), F.abs))


def l2_norm(a: Column) -> Column:
    return F.sqrt(ip(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 when a norm is too small."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na < MIN_NORM) | (nb < MIN_NORM), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ip(a, b) / (na * nb))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def cosine_normalized(a: Column, b: Column) -> Column:
    """For unit vectors; not clamped."""
    return 1 - ip(a, b)


def int_l2_sq(a: Column, b: Column) -> Column:
    """Squared L2 of integer vectors, exact."""
    parts = F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of packed bit words."""
    parts = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(parts, F.lit(0), lambda acc, x: acc + x).cast("bigint")


def sign_dot(a: Column, b: Column, dim: int) -> Column:
    """Inner product of +-1 vectors from their packed signs."""
    return F.lit(dim).cast("bigint") - 2 * hamming(a, b)


def contains(v: Column, x) -> Column:
    """Whether x is among the values; false for an empty or null array."""
    return F.coalesce(F.array_contains(v, x), F.lit(False))


def as_half(df: DataFrame, column: str) -> DataFrame:
    """The column's values rounded to 16-bit floats, kept as 32-bit ones."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(at)
            with np.errstate(over="ignore"):
                half = v.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
            sizes = np.array([0 if n is None else n for n in pc.list_value_length(v).to_pylist()], dtype=np.int64)
            nulls = pa.array(np.append(v.is_null().to_numpy(zero_copy_only=False), False))
            offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=nulls.to_numpy(zero_copy_only=False))
            columns = list(b.columns)
            columns[at] = pa.ListArray.from_arrays(offsets, pa.array(half))
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    fields = [f if f.name != column else T.StructField(column, T.ArrayType(T.FloatType())) for f in df.schema.fields]
    return df.mapInArrow(run, T.StructType(fields))


#: Distances by name; register your own here.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "l2_sq": l2_sq,
    "l2": l2,
    "ip": ip,
    "ip_score": ip_score,
    "ip_distance": ip_distance,
    "cosine": cosine_distance,
    "cosine_normalized": cosine_normalized,
    "int_l2_sq": int_l2_sq,
}
