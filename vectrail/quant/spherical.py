"""Spherical codes of 1, 2, 4 or 8 bits a value, and one interface and registry for all quantizers.

A vector less the centre is transformed and normalised; its code is the point
of a grid of half-integers of largest cosine with it. The correction, length
over the product of the code with the unit vector, makes inner products from
codes unbiased.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import centroid
from ..operators.search import matrix, scan
from .product import ProductQuantizer
from .rotated import TRANSFORMS, encode_table, magnitudes
from .rotated import search as rotated_search

CODED = "vec_id bigint, norm_sqr double, correction double, centre_ip double, codes array<int>"


class Quantizer(Protocol):
    """What all quantizers offer: ``fit`` on a table of vectors, ``encode`` a table, ``search`` codes for the k nearest of each query."""

    def fit(self, vectors: DataFrame) -> Quantizer: ...

    def encode(self, vectors: DataFrame) -> DataFrame: ...

    def search(self, encoded: DataFrame, queries: DataFrame, k: int, own: bool = True) -> DataFrame: ...


def grid(u: np.ndarray, bits: int) -> np.ndarray:
    """Codes c from 0 to 2**bits - 1 of the points c - (2**bits - 1) / 2 of largest cosine with u."""
    half = 1 << (bits - 1)
    m = magnitudes(u, half) if bits > 1 else np.zeros(u.shape, dtype=np.int64)
    return np.where(u > 0, half + m, half - 1 - m)


class Spherical:
    def __init__(self, bits: int, transform: str = "padding_hadamard", seed: int = 1, metric: str = "l2_sq"):
        if bits not in (1, 2, 4, 8) or metric not in ("l2_sq", "ip_score"):
            raise ValueError("1, 2, 4 or 8 bits, and l2_sq or ip_score")
        self.bits, self.transform, self.seed, self.metric = bits, transform, seed, metric
        self.centre: np.ndarray | None = None

    def fit(self, vectors: DataFrame) -> Spherical:
        self.centre = np.array(centroid(vectors).first()["qvec"], dtype=np.float64)
        return self

    def codes(self, x: np.ndarray) -> dict[str, np.ndarray]:
        r = x - self.centre
        norm = np.linalg.norm(r, axis=1)
        u = TRANSFORMS[self.transform](r / np.maximum(norm, 1e-300)[:, None], self.seed)
        c = grid(u, self.bits)
        product = ((c - (2**self.bits - 1) / 2) * u).sum(axis=1)
        return {"norm_sqr": norm**2, "correction": norm / np.maximum(product, 1e-300), "centre_ip": x @ self.centre, "codes": c}

    def encode(self, vectors: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    e = self.codes(matrix(b.column("vec"), b.num_rows).astype(np.float64))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), *(pa.array(e[k]) for k in ("norm_sqr", "correction", "centre_ip")), pa.array(list(e["codes"].astype(np.int32)), pa.list_(pa.int32()))], ["vec_id", "norm_sqr", "correction", "centre_ip", "codes"])

        return vectors.select("vec_id", "vec").mapInArrow(run, CODED)

    def search(self, encoded: DataFrame, queries: DataFrame, k: int, own: bool = True) -> DataFrame:
        """Top k by distance estimates from codes: squared L2, or the negated inner product."""
        centre, transform, seed, middle, metric = self.centre, TRANSFORMS[self.transform], self.seed, (2**self.bits - 1) / 2, self.metric

        def prepare(q: np.ndarray):
            return q, transform(q - centre, seed)

        def score(prepared, b: pa.RecordBatch) -> np.ndarray:
            q, y = prepared
            inner = b.column("correction").to_numpy()[None] * (y @ (matrix(b.column("codes"), b.num_rows) - middle).T)
            if metric == "l2_sq":
                return b.column("norm_sqr").to_numpy()[None] + np.square(y).sum(axis=1)[:, None] - 2 * inner
            # q x = (q - c)(x - c) + c x + c q - c c
            return -(inner + b.column("centre_ip").to_numpy()[None] + (q @ centre)[:, None] - centre @ centre)

        return scan(queries, encoded, k, score, prepare, own=own)


class Product:
    """Product quantization behind the interface; ``chunks`` of one value each are a scalar code book a dimension."""

    def __init__(self, chunks: int, centres: int):
        self.chunks, self.centres, self.model = chunks, centres, None

    def fit(self, vectors: DataFrame) -> Product:
        self.model = ProductQuantizer.train(vectors, self.chunks, self.centres)
        return self

    def encode(self, vectors: DataFrame) -> DataFrame:
        return self.model.encode(vectors)

    def search(self, encoded: DataFrame, queries: DataFrame, k: int, own: bool = True) -> DataFrame:
        return self.model.search(encoded, queries, k, own)


class Rotated:
    """4-bit rotated codes behind the interface."""

    def __init__(self, residual_bits: int = 0):
        self.residual_bits, self.centre = residual_bits, None

    def fit(self, vectors: DataFrame) -> Rotated:
        self.centre = list(centroid(vectors).first()["qvec"])
        return self

    def encode(self, vectors: DataFrame) -> DataFrame:
        return encode_table(vectors, self.centre, bits=self.residual_bits)

    def search(self, encoded: DataFrame, queries: DataFrame, k: int, own: bool = True) -> DataFrame:
        return rotated_search(encoded, queries, self.centre, k, own=own)


#: Quantizers by name; register your own here.
QUANTIZERS: dict[str, Callable[[], Quantizer]] = {f"spherical_{b}": (lambda b=b: Spherical(b)) for b in (1, 2, 4, 8)} | {
    "product": lambda: Product(32, 256),
    "product_1d": lambda: Product(64, 16),
    "rotated_4": Rotated,
}


def sweep(coarse: DataFrame, queries: DataFrame, base: DataFrame, truth: DataFrame, k: int, sizes: list[int]) -> DataFrame:
    """(candidates, recall): recall of exact rerank of the first c coarse candidates, for each c of ``sizes``, in one pass over the largest."""
    from ..operators.search import METRICS, top_k

    kept = top_k(coarse, max(sizes), rank="coarse_rank").select("query_id", "vec_id", "coarse_rank")
    exact = kept.join(base.select("vec_id", "vec"), "vec_id").join(queries.select("query_id", "qvec"), "query_id").withColumn("dist", METRICS["l2_sq"](F.col("qvec"), F.col("vec")))
    each = exact.withColumn("candidates", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("coarse_rank") <= F.col("candidates"))
    best = top_k(each, k, keys=("candidates", "query_id"))
    hits = best.join(truth.filter(F.col("rank") <= k).select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").groupBy("candidates").agg(F.count(F.lit(1)).alias("hits"))
    n = truth.agg(F.countDistinct("query_id").alias("n"))
    return hits.join(F.broadcast(n)).select("candidates", (F.col("hits") / (F.col("n") * k)).alias("recall"))
