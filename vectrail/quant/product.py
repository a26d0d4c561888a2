"""Product quantization, k-means and inverted lists, trained on bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import matrix, scan

SAMPLE = 8192


def sample_matrix(vectors: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """At most ``rows`` vectors, in the order of a hash."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("vec").collect()
    return np.array([r[0] for r in got], dtype=np.float64)


def kmeans(x: np.ndarray, k: int, seed: int = 1, turns: int = 12) -> np.ndarray:
    """k-means++ starts and Lloyd turns; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    near = np.square(x - centres[0]).sum(axis=1)
    while len(centres) < min(k, len(x)):
        p = near / near.sum() if near.sum() > 0 else np.full(len(x), 1 / len(x))
        centres = np.vstack([centres, x[rng.choice(len(x), p=p)]])
        near = np.minimum(near, np.square(x - centres[-1]).sum(axis=1))
    for _ in range(turns):
        at = assign(x, centres)
        for c in range(len(centres)):
            if (at == c).any():
                centres[c] = x[at == c].mean(axis=0)
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (np.square(centres).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


class ProductQuantizer:
    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @classmethod
    def train(cls, vectors: DataFrame, chunks: int, centres: int, seed: int = 1) -> ProductQuantizer:
        x = sample_matrix(vectors)
        return cls([kmeans(part, centres, seed + i) for i, part in enumerate(np.split(x, chunks, axis=1))])

    def encode(self, vectors: DataFrame) -> DataFrame:
        """vec_id, codes."""
        shared = vectors.sparkSession.sparkContext.broadcast(self.books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.stack(b.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
                    codes = np.stack([assign(p, c) for p, c in zip(np.split(x, len(shared.value), axis=1), shared.value, strict=True)], axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))], ["vec_id", "codes"])

        return vectors.select("vec_id", "vec").mapInArrow(run, "vec_id bigint, codes array<int>")

    def search(self, encoded: DataFrame, queries: DataFrame, k: int, own: bool = True) -> DataFrame:
        """Top k by the sum of table entries (asymmetric distance); a task gives k rows a query."""
        books = self.books

        def prepare(q: np.ndarray) -> list[np.ndarray]:
            return [np.square(part[:, None] - c[None]).sum(axis=2) for part, c in zip(np.split(q, len(books), axis=1), books, strict=True)]

        def score(tables: list[np.ndarray], b: pa.RecordBatch) -> np.ndarray:
            codes = matrix(b.column("codes"), b.num_rows)
            return sum(t[:, codes[:, i]] for i, t in enumerate(tables))

        return scan(queries, encoded, k, score, prepare, own=own)


def lists_of(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``list``, the nearest centre, to (vec_id, vec, ...): the partition key of an inverted index."""
    schema = vectors.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.stack(b.column("vec").to_numpy(zero_copy_only=False)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(assign(x, centres).astype(np.int32))], [*b.schema.names, "list"])

    return vectors.mapInArrow(run, f"{fields}, list int")


def probe_lists(queries: DataFrame, centres: np.ndarray, n_probe: int) -> DataFrame:
    """(query_id, qvec, list) of the n_probe nearest lists of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = matrix(b.column("qvec"), b.num_rows).astype(np.float64)
                near = (np.square(centres).sum(axis=1)[None] - 2 * q @ centres.T).argsort(axis=1, kind="stable")[:, :n_probe]
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("qvec").take(at), pa.array(near.ravel().astype(np.int32))], ["query_id", "qvec", "list"])

    kind = queries.schema["qvec"].dataType.simpleString()
    return queries.select("query_id", "qvec").mapInArrow(run, f"query_id bigint, qvec {kind}, list int")
