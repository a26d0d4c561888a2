"""Ordered mutation logs (stage, op, id, offset): state as of a stage, validation, live upserts, vector sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def active_at(log: DataFrame, stage: int) -> DataFrame:
    """(id, offset) alive after ``stage``: the last event of each id, without deletes."""
    last = log.filter((F.col("stage") <= stage) & (F.col("op") != "search")).groupBy("id").agg(F.max_by(F.struct("op", "offset"), "stage").alias("e"))
    return last.filter(F.col("e.op") != "delete").select("id", F.col("e.offset").alias("offset"))


def read_runbook(spark: SparkSession, steps: dict, max_points: int | None = None) -> DataFrame:
    """A log from numbered steps {operation, start, end} (or ids_start for where a replace takes its vectors), a range of ids each.

    Steps need not be numbered without gaps; they keep their order. More points
    alive at once than ``max_points`` are an error.
    """
    rows, alive = [], 0
    for stage, (_, step) in enumerate(sorted((int(k), v) for k, v in steps.items())):
        op = step["operation"]
        if op not in ("insert", "delete", "replace", "search"):
            raise ValueError(f"unknown operation {op}")
        if op != "search":
            n = step["end"] - step["start"]
            if n <= 0:
                raise ValueError(f"step {stage} has no ids")
            alive += n * {"insert": 1, "delete": -1, "replace": 0}[op]
            if max_points is not None and alive > max_points:
                raise ValueError(f"{alive} points after step {stage}, more than {max_points}")
        rows.append((stage, op, step.get("start", 0), step.get("end", 1), step.get("ids_start", step.get("start", 0))))
    plan = spark.createDataFrame(rows, "stage int, op string, first bigint, last bigint, source bigint")
    return plan.withColumn("id", F.explode(F.sequence("first", F.col("last") - 1))).select("stage", "op", "id", (F.col("source") + F.col("id") - F.col("first")).alias("offset"))


def run_stages(log: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, maintain=None) -> DataFrame:
    """stage, query_id, rank, vec_id, dist of the searches of a log, each over what is alive at its stage. ``maintain(stage, alive)`` is called after every stage that deletes."""
    from ..operators.search import knn_arrow

    out = None
    for r in log.groupBy("stage").agg(F.collect_set("op").alias("ops")).orderBy("stage").collect():
        alive = active_at(log, r["stage"]).join(vectors.select(F.col("vec_id").alias("offset"), "vec"), "offset").select(F.col("id").alias("vec_id"), "vec")
        if "delete" in r["ops"] and maintain is not None:
            maintain(r["stage"], alive)
        if "search" in r["ops"]:
            found = knn_arrow(queries, alive, k).withColumn("stage", F.lit(r["stage"]))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("the log has no search")
    return out


def validate(log: DataFrame) -> DataFrame:
    """Events that can't be: an insert of a present id, a delete or replace of an absent one."""
    before = F.lag("op").over(Window.partitionBy("id").orderBy("stage"))
    present = F.coalesce(before, F.lit("delete")) != "delete"
    bad = F.when((F.col("op") == "insert") & present, "insert of a present id").when(F.col("op").isin("delete", "replace") & ~present, F.concat(F.col("op"), F.lit(" of an absent id")))
    return log.filter("op <> 'search'").withColumn("error", bad).filter("error is not null").select("stage", "op", "id", "error")


def last_write(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))).filter("_r = 1").drop("_r")


def upsert_stream(stream: DataFrame, path: str, checkpoint: str):
    """Writes each batch of a mutation stream to its own folder, so a replayed batch overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last_write(batch.withColumn("batch_id", F.lit(batch_id)), "id", ["stage"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state that the batches written so far give."""
    return last_write(spark.read.option("basePath", path).parquet(f"{path}/batch=*"), "id", ["stage", "batch_id"]).filter("op <> 'delete'")


class VectorSet:
    """Vectors with attributes by element: add, remove, set_attribute, search by vector or element, card.

    Each change gives a new set over immutable DataFrames; tombstones are applied by anti-joins.
    """

    def __init__(self, rows: DataFrame, metric: str = "cosine"):
        self.rows, self.metric = rows, metric

    def add(self, rows: DataFrame) -> VectorSet:
        return VectorSet(self.rows.join(rows, "vec_id", "left_anti").unionByName(rows, allowMissingColumns=True), self.metric)

    def remove(self, ids: DataFrame) -> VectorSet:
        return VectorSet(self.rows.join(ids, "vec_id", "left_anti"), self.metric)

    def set_attribute(self, values: DataFrame) -> VectorSet:
        kept = self.rows.drop("attribute").join(values.select("vec_id", "attribute"), "vec_id", "left")
        return VectorSet(kept, self.metric)

    def card(self) -> int:
        return self.rows.count()

    def contains(self, vec_id: int) -> bool:
        return not self.rows.filter(F.col("vec_id") == vec_id).isEmpty()

    def search(self, vector: list[float], k: int, where=None) -> DataFrame:
        from ..operators.search import knn

        q = self.rows.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query_id bigint, qvec array<double>")
        base = self.rows if where is None else self.rows.filter(where)
        return knn(q, base.select("vec_id", "vec"), k, self.metric)

    def search_by_element(self, vec_id: int, k: int) -> DataFrame:
        row = self.rows.filter(F.col("vec_id") == vec_id).select("vec").first()
        if row is None:
            raise KeyError(vec_id)
        return self.search(row[0], k, F.col("vec_id") != vec_id)
