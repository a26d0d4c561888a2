"""From run results to tables: dedup, medians, gates, Pareto fronts, interpolation, choice of configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def median_runs(df: DataFrame, keys: list[str], values: list[str], first: list[str], order: Column) -> DataFrame:
    """Medians over repeats; other columns come from the first repeat."""
    return df.groupBy(*keys).agg(*(F.median(v).alias(v) for v in values), *(F.min_by(c, order).alias(c) for c in first), F.count(F.lit(1)).alias("repeats"))


def cv_gate(df: DataFrame, keys: list[str], value: str, most: float = 0.05) -> DataFrame:
    """Coefficient of variation of each group, and whether it passes."""
    cv = F.when(F.avg(value) == 0, 0.0).otherwise(F.stddev_pop(value) / F.avg(value))
    return df.groupBy(*keys).agg(cv.alias("cv")).withColumn("passed", F.col("cv") <= most)


def pareto_front(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Best y of each x (rounded to 10 digits), kept where y is above that of every larger x."""
    best = df.withColumn(x, F.round(x, 10)).groupBy(*keys, x).agg(F.max(y).alias(y))
    before = Window.partitionBy(*keys).orderBy(F.col(x).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_m", F.max(y).over(before)).filter(F.col("_m").isNull() | (F.col(y) > F.col("_m"))).drop("_m")


def interpolate(df: DataFrame, x: str, y: str, keys: list[str], targets: list[float], best_available: bool = True) -> DataFrame:
    """y at each target x, linear between the neighbours.

    Nothing if the largest x is under the target by more than 1e-9. If the
    smallest x already reaches the target, its own row is the answer
    (``best_available``); otherwise ends are clamped and every target answered.
    """
    w = Window.partitionBy(*keys).orderBy(x, y)
    rows = df.withColumn("x2", F.lead(x).over(w)).withColumn("y2", F.lead(y).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    t = F.col("target")
    rows = rows.withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    low = F.col("_first") & (F.col(x) >= t)
    inside = (F.col(x) < t) & (F.col("x2") >= t)
    last = F.col("x2").isNull() & (F.col(x) < t) & ((F.col(x) >= t - 1e-9) if best_available else F.lit(True))
    value = F.when(inside, F.col(y) + (F.col("y2") - F.col(y)) * (t - F.col(x)) / (F.col("x2") - F.col(x))).otherwise(F.col(y))
    mode = F.when(inside, "linear").otherwise("best_available" if best_available else "clamped")
    return rows.filter(low | inside | last).select(*keys, "target", value.alias(y), mode.alias("interp"))


def best_config(df: DataFrame, keys: list[str], target: float) -> DataFrame:
    """The configuration of most qps among those that reach the recall, else that of most recall."""
    ok = F.col("recall") >= target
    pick = F.struct(ok.cast("int").alias("ok"), F.when(ok, F.col("qps")).otherwise(F.col("recall")).alias("v"), "config_id", "recall", "qps")
    return df.groupBy(*keys).agg(F.max(pick).alias("p")).select(*keys, "p.config_id", "p.recall", "p.qps")


def runs_of(df: DataFrame, key: str, page: str) -> DataFrame:
    """Adjacent pages of each key as one request: first page and number of pages."""
    rows = df.select(key, page).distinct()
    group = F.col(page) - F.row_number().over(Window.partitionBy(key).orderBy(page))
    return rows.withColumn("_g", group).groupBy(key, "_g").agg(F.min(page).alias("first_page"), F.count(F.lit(1)).alias("n_pages")).drop("_g")


def number_in(label: Column) -> Column:
    """The first number in a label, else 0.0."""
    return F.coalesce(F.when(label.rlike(r"[0-9]"), F.regexp_extract(label, r"([-+]?[0-9]*\.?[0-9]+)", 1).try_cast("double")), F.lit(0.0))


def with_config(results: DataFrame, configs: DataFrame, keys: list[str]) -> DataFrame:
    """Results with the settings of their configuration; results without one are an error, not lost."""
    absent = results.join(configs, keys, "left_anti").select(*keys).limit(1)
    if not absent.isEmpty():
        raise KeyError(f"no configuration for {absent.first().asDict()}")
    return results.join(configs, keys)


def with_metadata(rows: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Metric rows with what is known of their candidates; rows without metadata stay, with nulls."""
    return rows.join(metadata, keys, "left")


def page_requests(requests: DataFrame, capacity: int) -> DataFrame:
    """query_id, pos, page, cached: whether one of the query's last ``capacity`` different pages is asked for again (least recently used goes first)."""
    w = Window.partitionBy("query_id", "page").orderBy("pos")
    last = requests.withColumn("before", F.lag("pos").over(w))
    # different pages since the last request of this one
    seen = last.select("query_id", F.col("pos").alias("p2"), F.col("page").alias("page2"))
    between = last.filter("before is not null").join(seen, "query_id").filter("p2 > before and p2 < pos").groupBy("query_id", "pos").agg(F.countDistinct("page2").alias("others"))
    out = last.join(between, ["query_id", "pos"], "left")
    return out.select("query_id", "pos", "page", (F.col("before").isNotNull() & (F.coalesce("others", F.lit(0)) < capacity)).alias("cached"))
