"""Quantizers whose codes are expressions: binary, min-max, scalar, query codecs and polar blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, total


def binary_codes(v: Column) -> Column:
    return F.transform(doubles(v), lambda x: F.when(x > 0, 1).otherwise(0).cast("bigint"))


def minmax(v: Column, bits: int, grid_scale: float = 1.0) -> Column:
    """STRUCT(low, step, codes): each vector on a grid over its own range, clamped, then rounded.

    The range is the half width of the values times ``grid_scale`` on both sides of the middle.
    """
    levels = 2**bits - 1
    v = doubles(v)
    mid, half = (F.array_max(v) + F.array_min(v)) / 2, (F.array_max(v) - F.array_min(v)) / 2 * grid_scale
    low, step = mid - half, 2 * half / levels
    code = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(float(levels)), (x - low) / step))).cast("bigint")
    return F.struct(low.alias("low"), step.alias("step"), F.transform(v, lambda x: F.when(step == 0, F.lit(0).cast("bigint")).otherwise(code(x))).alias("codes"))


def decode(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["low"] + q["step"] * c)


def recompress(q: Column, bits: int, fewer: int) -> Column:
    """STRUCT(low, step, codes) of ``bits`` on a grid of ``fewer`` bits over the same range."""
    levels, less = 2**bits - 1, 2**fewer - 1
    code = lambda c: F.round(c * less / levels).cast("bigint")
    return F.struct(q["low"].alias("low"), (q["step"] * levels / less).alias("step"), F.transform(q["codes"], code).alias("codes"))


@dataclass(frozen=True)
class ScalarQuantizer:
    """One step for all dimensions: shift = mean - p, scale = 2 p, p = deviations * largest standard deviation."""

    shift: list[float]
    scale: float
    bits: int

    @classmethod
    def train(cls, vectors: DataFrame, bits: int, deviations: float = 2.0) -> ScalarQuantizer:
        rows = sorted(scalar_model(vectors, deviations).collect())
        return cls([r["shift"] for r in rows], rows[0]["scale"], bits)

    def codes(self, v: Column) -> Column:
        top = float(2**self.bits - 1)
        shift = F.array(*map(F.lit, self.shift))
        return F.zip_with(doubles(v), shift, lambda x, s: F.round(F.greatest(F.lit(0.0), F.least(F.lit(top), (x - s) / self.scale * top))).cast("bigint"))

    def decode(self, codes: Column) -> Column:
        top = float(2**self.bits - 1)
        return F.zip_with(codes, F.array(*map(F.lit, self.shift)), lambda c, s: s + c * self.scale / top)


    def ip(self, a: Column, b: Column) -> Column:
        """Inner product of two coded vectors from codes: their product, and what the shifts add to it."""
        step = self.scale / float(2**self.bits - 1)
        shift = F.array(*map(F.lit, self.shift))
        product = total(F.zip_with(a, b, lambda x, y: (x * y).cast("double"))) * step * step
        shifted = lambda c: total(F.zip_with(c, shift, lambda x, s: x * s)) * step
        return product + shifted(a) + shifted(b) + F.lit(sum(x * x for x in self.shift))

    def l2_sq(self, a: Column, b: Column) -> Column:
        """Squared distance of two coded vectors; shifts cancel out."""
        step = self.scale / float(2**self.bits - 1)
        return total(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)).cast("double"))) * step * step

    def cosine(self, a: Column, b: Column) -> Column:
        """1 - cosine similarity of two coded vectors, clamped; 1 where one is zero."""
        size = F.sqrt(self.ip(a, a)) * F.sqrt(self.ip(b, b))
        return 1 - F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), self.ip(a, b) / size))).otherwise(0.0)


def percentile_model(vectors: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """dim, shift, scale: a range of its own for each dimension, from percentiles."""
    values = vectors.select(F.posexplode(doubles("vec")).alias("dim", "x"))
    p = values.groupBy("dim").agg(F.percentile("x", F.lit(low)).alias("a"), F.percentile("x", F.lit(high)).alias("b"))
    return p.select(F.col("dim").cast("bigint").alias("dim"), F.col("a").alias("shift"), (F.col("b") - F.col("a")).alias("scale"))


def scalar_model(vectors: DataFrame, deviations: float = 2.0) -> DataFrame:
    """dim, shift, scale: one row a dimension."""
    stats = vectors.select(F.posexplode(doubles("vec")).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s2"))
    top = stats.agg((F.sqrt(F.max("s2")) * deviations).alias("p"))
    return stats.join(F.broadcast(top)).select(F.col("dim").cast("bigint").alias("dim"), (F.col("m") - F.col("p")).alias("shift"), (2 * F.col("p")).alias("scale"))


def query_codec(v: Column, bits: int) -> Column:
    """STRUCT(scale, codes): 1 bit keeps signs and the mean magnitude; more bits round half to even on the largest."""
    v = doubles(v)
    if bits == 1:
        scale = total(F.transform(v, F.abs)) / F.size(v)
        return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.when(x > 0, 1).otherwise(-1).cast("bigint")).alias("codes"))
    scale = F.array_max(F.transform(v, F.abs)) / float(2 ** (bits - 1) - 1)
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.when(scale == 0, F.lit(0).cast("bigint")).otherwise(F.rint(x / scale).cast("bigint"))).alias("codes"))


def signs_dot(codec: Column, signs: Column) -> Column:
    """Inner product of a coded query with base signs."""
    parts = F.zip_with(codec["codes"], signs, lambda c, s: c * s)
    return codec["scale"] * F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def polar_blocks(v: Column, angles: int = 16, magnitudes: int = 16) -> Column:
    """Pairs of values as angle and magnitude codes, the magnitudes on the vector's largest."""
    v = doubles(v)
    pairs = F.transform(F.sequence(F.lit(0), F.size(v) - 2, F.lit(2)), lambda i: F.struct(F.get(v, i).alias("x"), F.get(v, i + 1).alias("y")))
    size = lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
    top = F.array_max(F.transform(pairs, size))
    turn = 6.283185307179586
    return F.transform(pairs, lambda p: (F.pmod(F.round(F.atan2(p["y"], p["x"]) / turn * angles).cast("bigint"), F.lit(angles)) * magnitudes + F.round(size(p) / top * (magnitudes - 1)).cast("bigint")))
