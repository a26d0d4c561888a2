"""Readers and writers of vector files, by Spark's own file access so that any store works.

fvecs / ivecs: each row is an int32 dimension and as many 32-bit values.
bin: uint32 rows, uint32 columns, then 32-bit floats.
graph: uint64 size, uint32 degree, uint32 start, uint64 starts, then for each node uint32 count and ids.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(content: bytes, kind: str) -> np.ndarray:
    if not content:
        return np.empty((0, 0), dtype=kind)
    dim = int.from_bytes(content[:4], "little", signed=True)
    size = 4 * (dim + 1)
    if dim <= 0 or len(content) % size:
        raise ValueError(f"a row of dimension {dim} doesn't divide {len(content)} bytes")
    table = np.frombuffer(content, dtype="<i4").reshape(-1, dim + 1)
    if (table[:, 0] != dim).any():
        raise ValueError("rows differ in dimension")
    return np.ascontiguousarray(table[:, 1:]).view(kind)


def _bin(content: bytes) -> np.ndarray:
    n, dim = struct.unpack("<II", content[:8])
    if len(content) != 8 + 4 * n * dim:
        raise ValueError(f"{n} x {dim} values need {8 + 4 * n * dim} bytes; the file has {len(content)}")
    return np.frombuffer(content, dtype="<f4", offset=8).reshape(n, dim)


def _read(spark: SparkSession, path: str, parse, column: str, kind: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows = parse(content)
                for at in range(0, len(rows), 65536):
                    part = rows[at : at + 65536]
                    yield pd.DataFrame({"file": name, "row": np.arange(at, at + len(part)), column: list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, row bigint, {column} array<{kind}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """file, row, vec; one file is one task, so large tables come as many files."""
    return _read(spark, path, lambda c: _rows(c, "<f4"), "vec", "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda c: _rows(c, "<i4"), "ids", "int")


def read_bin(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, _bin, "vec", "float")


def ground_truth(ivecs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id of the first k ids of each row."""
    return ivecs.select(F.col("row").alias("query_id"), F.posexplode(F.slice("ids", 1, k)).alias("p", "i")).select("query_id", (F.col("p") + 1).cast("bigint").alias("rank"), F.col("i").cast("bigint").alias("vec_id"))


def encode_fvecs(rows: np.ndarray) -> bytes:
    rows = np.asarray(rows, dtype="<f4")
    return np.hstack([np.full((len(rows), 1), rows.shape[1], dtype="<i4"), rows.view("<i4")]).tobytes()


def encode_ivecs(rows: np.ndarray) -> bytes:
    rows = np.asarray(rows, dtype="<i4")
    return np.hstack([np.full((len(rows), 1), rows.shape[1], dtype="<i4"), rows]).tobytes()


def encode_bin(rows: np.ndarray) -> bytes:
    rows = np.asarray(rows, dtype="<f4")
    return struct.pack("<II", *rows.shape) + rows.tobytes()


def write_binary(df: DataFrame, column: str, path: str, encode=encode_fvecs, order: str = "vec_id") -> DataFrame:
    """One encoded file content a partition, as a table (first id, content) that any byte sink can store."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                frame = frame.sort_values(order)
                yield pd.DataFrame({"first": [int(frame[order].iloc[0])], "content": [encode(np.stack(frame[column]))]})

    out = df.repartitionByRange(order).select(order, column).mapInPandas(run, "first bigint, content binary")
    out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def store(table: DataFrame, folder: str, suffix: str) -> int:
    """Each content of ``write_binary`` as a file of its own in ``folder`` of any store that Spark reaches; the number of files. One content at a time passes the driver."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    n = 0
    for n, r in enumerate(table.select("first", "content").toLocalIterator(), 1):  # noqa: B007
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/part-{r['first']:020d}.{suffix}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytes(r["content"]))
        finally:
            out.close()
    return n


def append_csv(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files, each of which has the header once."""
    df.write.mode("append").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def save_index(folder: str, model: dict, **tables: DataFrame) -> None:
    """An index as a folder: a model of plain values as JSON, and tables (vectors, codes, edges, ...) as Parquet."""
    if not tables:
        raise ValueError("an index has at least one table")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps({"model": model, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model")


def load_index(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame]]:
    """The model and the tables of a saved index."""
    held = json.loads(spark.read.text(f"{folder}/model").first()[0])
    return held["model"], {name: spark.read.parquet(f"{folder}/{name}") for name in held["tables"]}


def id_hash(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, hash: 64-bit FNV-1a over the little-endian 32-bit ids of an array, as a signed BIGINT."""
    # fixed values of the hash
    basis, prime = 0xCBF29CE484222325, 0x100000001B3

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for ids in frame[column]:
                h = basis
                for byte in np.asarray(ids if ids is not None else [], dtype="<u4").tobytes():
                    h = ((h ^ byte) * prime) & 0xFFFFFFFFFFFFFFFF
                out.append(h - (1 << 64) if h >> 63 else h)
            yield pd.DataFrame({key: frame[key], "hash": out})

    return df.select(key, column).mapInPandas(run, f"{key} bigint, hash bigint")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, pos, dst, start of graph files; a node without neighbours has one row with nulls. The file's own length counts, whatever its header says."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                if len(content) < 24 or len(content) % 4:
                    raise ValueError("the file is cut off")
                _, _, start, _ = struct.unpack("<QIIQ", content[:24])
                words, at, node, rows = np.frombuffer(content, dtype="<u4", offset=24), 0, 0, []
                while at < len(words):
                    n = int(words[at])
                    if at + 1 + n > len(words):
                        raise ValueError("the file is cut off")
                    rows += [(node, p, int(d), start) for p, d in enumerate(words[at + 1 : at + 1 + n])] or [(node, None, None, start)]
                    at, node = at + 1 + n, node + 1
                out = pd.DataFrame(rows, columns=["src", "pos", "dst", "start"])
                yield out.astype({"pos": "Int32", "dst": "Int64"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "src bigint, pos int, dst bigint, start bigint")


def encode_graph(adjacency: list[list[int]], degree: int, start: int) -> bytes:
    body = b"".join(struct.pack(f"<I{len(a)}I", len(a), *a) for a in adjacency)
    return struct.pack("<QIIQ", 24 + len(body), degree, start, 0) + body


def adjacency_checksum(edges: DataFrame) -> DataFrame:
    """src, sha256 of its ordered neighbours."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"].cast("string"))
    return edges.groupBy("src").agg(F.sha2(F.array_join(ids, ","), 256).alias("checksum"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and the whole JSON label of each line."""
    line = F.try_parse_json("value")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.try_variant_get(line, "$.doc_id", "bigint").alias("doc_id"), F.col("value").alias("label"))


def read_filter_queries(spark: SparkSession, path: str) -> DataFrame:
    line = F.try_parse_json("value")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.try_variant_get(line, "$.query_id", "bigint").alias("query_id"), F.try_variant_get(line, "$.filter", "string").alias("filter"))


def read_filter_truth(spark: SparkSession, path: str) -> DataFrame:
    """query_id, count, ids, distances of each line of filtered ground truth."""
    return spark.read.schema("query_id bigint, count bigint, ids array<bigint>, distances array<double>").json(path)


def tsv_lines(df: DataFrame, key: str, column: str) -> DataFrame:
    """Lines of tab-separated %.6g values."""
    return df.select(key, F.array_join(F.transform(column, lambda x: F.format_string("%.6g", x.cast("double"))), "\t").alias("line"))


def parse_log(lines: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """name=value pairs of log lines as typed columns."""
    return lines.select(*(F.regexp_extract(column, rf"\b{name}=([^\s,;]+)", 1).try_cast(kind).alias(name) for name, kind in fields.items()))


def validate(vectors: DataFrame, key: str = "vec_id", column: str = "vec") -> DataFrame:
    """n_rows, n_ids, n_null, min_dim, max_dim of a table."""
    return vectors.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_ids"), F.count_if(F.col(column).isNull()).alias("n_null"), F.min(F.size(column)).cast("bigint").alias("min_dim"), F.max(F.size(column)).cast("bigint").alias("max_dim"))


def split_queries(queries: DataFrame, key: str, n: int) -> DataFrame:
    """The first n by key are for validation, the rest for tests."""
    last = queries.orderBy(key).limit(n).agg(F.max(key).alias("_last"))
    return queries.join(F.broadcast(last)).withColumn("part", F.when(F.col(key) <= F.col("_last"), "validation").otherwise("test")).drop("_last")


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int, norm: float = 1.0) -> DataFrame:
    """Gaussian directions of one norm; each row depends on the seed and its id only."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([np.random.default_rng([seed, i]).standard_normal(dim) for i in frame["id"]]).reshape(len(frame), dim)
            x *= norm / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"vec_id": frame["id"], "vec": list(x.astype(np.float32))})

    return spark.range(n).mapInPandas(run, "vec_id bigint, vec array<float>")


def zipf_labels(spark: SparkSession, n: int, labels: int, seed: int) -> DataFrame:
    """Labels 1..labels with frequencies as 1 / label."""
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    weights = np.cumsum(1 / np.arange(1, labels + 1))
    cuts = F.array(*map(F.lit, (weights / weights[-1]).tolist()))
    return spark.range(n).select(F.col("id").alias("vec_id"), (F.size(F.filter(cuts, lambda c: c <= u)) + 1).alias("label"))
