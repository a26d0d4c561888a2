"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all have the expected number of copies target / size,
at most 3. The whole part is certain. The fractional parts are rounded by the
pivotal method: two undecided documents meet, and mass moves at random from
one to the other, keeping both expectations and the sum, until one of them is
0 or 1; the other goes on to the next. Documents meet in order of size, so that
the words of the two are nearly the same and the source's words stay near its
target.

Rows of one doc_id, source and size are one document with a number of rows:
their copies are counted together, dealt out evenly, and only the fraction of
their sum takes part. So repeated rows, however many, are one row of the
tournament.

The tournament is a reduction tree. Documents are dealt to leaves of about
``LEAF`` rows by a hash, each leaf leaves at most one undecided document, and
those meet again, ``FAN_IN`` leaves in a group, up to the root of each source.
A source with a third of all rows has more leaves, not a larger one. Random
numbers are hashes of the two documents, so reruns agree. Sources are ranked
and their level is found by distributed sorts and sums, so there may be many.

Defined results: a null text has size 0; a source whose words are none has
target 0; a null source is a source of its own, last in order; a null doc_id is
an id like others; an empty table gives an empty result; repeated rows each get
their share of the copies; very long texts are only counted and joined; extra
columns are not read by ``mix_sizes`` and kept by ``take_copies``, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, free_names, stage_table, table

MAX_COPIES = 3
LEAF = 2048
FAN_IN = 256
WEIGHTS = (1, 2, 3)

ROWS = "doc_id long, source string, size long, n_rows long, source_size long, target double, whole long, p double, copy int"


def n_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    ends = F.when(F.element_at(parts, 1) == "", 1).otherwise(0) + F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - ends).cast("long")


def ranked(rows: DataFrame, by: str, name: str) -> DataFrame:
    """``rows``, written in the order of ``by`` with nulls last, with their place from 0 as ``place``. Only counts of partitions meet in one task."""
    done = stage_table(rows.orderBy(F.col(by).asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()), name)
    # an id is the partition's number times 2**33 and the row's place in it
    part = F.shiftright("id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = done.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return done.withColumn("part", part).join(starts, "part").withColumn("place", F.col("start") + F.col("id") - F.shiftleft("part", 33)).drop("id", "part", "start")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n_docs, target: one row for each source. ``sizes`` has source, size and n_rows.

    Shares are weight * level, stopped at cap * size: each turn finds the level
    of the sources that aren't stopped, and stops those it lifts too high.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("double")
    per = stage_table(ranked(per, "source", "sources").withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))), "weights")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        # the level only rises, so what is stopped once stays so
        over = F.lit(level) * F.col("weight") > F.col("most") if stopped >= 0 else F.lit(False)
        n, used, open_weight = per.agg(F.count_if(over), F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or n == stopped:
            break
        stopped, level = n, (total - used) / open_weight
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("most"), F.col("weight") * F.lit(level)))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def uniform(a: int, b: int, level: int) -> float:
    """A number in [0, 1) that depends on two ids and the level only."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + level * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) / 2.0**64


def pivotal(p: np.ndarray, ids: np.ndarray, level: int) -> np.ndarray:
    """Rounds all but at most one of ``p`` to 0 or 1, keeping their sum."""
    p = p.tolist()
    ids = [int(i) for i in ids]
    tiny = 1e-12
    i = -1
    for j in range(len(p)):
        if p[j] <= tiny or p[j] >= 1 - tiny:
            p[j] = float(round(p[j]))
            continue
        if i < 0:
            i = j
            continue
        a, b = p[i], p[j]
        u = uniform(ids[i], ids[j], level)
        if a + b < 1:
            if u * (a + b) < b:
                p[i], p[j] = 0.0, a + b
            else:
                p[i], p[j] = a + b, 0.0
        elif u * (2 - a - b) < 1 - b:
            p[i], p[j] = 1.0, a + b - 1
        else:
            p[i], p[j] = a + b - 1, 1.0
        undecided = [k for k in (i, j) if tiny < p[k] < 1 - tiny]
        for k in (i, j):
            if k not in undecided:
                p[k] = float(round(p[k]))
        i = undecided[0] if undecided else -1
    return np.array(p)


def decider(level: int, last: bool):
    """One node of the tree: rounds the documents of a group but at most one."""

    def decide(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable")
        p = pivotal(x["p"].to_numpy(), x["doc_id"].fillna(-1).to_numpy(), level)
        if last:  # the root's last document takes the nearer whole number
            p = np.where((p > 0) & (p < 1), (p >= 0.5).astype(float), p)
        return x.assign(p=p, copy=np.where(p >= 1, 1, np.where(p <= 0, 0, -1)))

    return decide


def mix_documents(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, leaf_rows: int = LEAF) -> DataFrame:
    """doc_id, source, size, n_rows, source_size, target, copies (of all rows together): one row for each doc_id, source and size of ``sizes``, which should be a written table."""
    documents = stage_table(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n_rows")), "documents")
    targets = stage_table(source_targets(documents, weights), "targets")
    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    rate = F.col("n_rows") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    leaves = F.ceil(F.col("n_docs") / F.lit(leaf_rows))
    rows = (
        documents.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("whole", F.floor(rate).cast("long"))
        .withColumn("p", rate - F.col("whole"))
        .withColumn("leaf", F.pmod(F.xxhash64("doc_id", "size"), leaves).cast("long"))
        .select("doc_id", "source", "size", "n_rows", "source_size", "target", "whole", "p", "leaf")
    )
    n, level, done = max(1, -(-int(most_docs) // leaf_rows)), 0, []
    while True:
        last = n == 1
        decided = stage_table(rows.groupBy("source", "leaf").applyInPandas(decider(level, last), f"{ROWS}, leaf long"), f"mix{level}")
        done.append(decided.filter("copy >= 0"))
        if last:
            break
        n = -(-n // FAN_IN)
        level += 1
        rows = decided.filter("copy < 0").drop("copy").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("long"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "size", "n_rows", "source_size", "target", (F.col("whole") + F.col("copy")).alias("copies"))


def times(n: Column, at: str, df: DataFrame) -> DataFrame:
    """Rows of ``df`` n times each, numbered from 1 as ``at``; numbers come in pieces, so none is a long array."""
    piece = 4096
    some = df.withColumn(at, n.cast("long")).filter(F.col(at) > 0).withColumn(at, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col(at) - 1, F.lit(piece).cast("long")), lambda k: F.struct(k.alias("from"), F.least(k + piece, F.col(at)).alias("to")))))
    return some.withColumn(at, F.explode(F.sequence(F.col(at)["from"] + 1, F.col(at)["to"])))


def mix_sizes(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, leaf_rows: int = LEAF) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for rows of (doc_id, source, size), which should be a written table."""
    rows = times(F.col("n_rows"), "at", mix_documents(sizes, weights, leaf_rows))
    own = F.floor(F.col("copies") / F.col("n_rows")) + (F.col("at") <= F.col("copies") % F.col("n_rows")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", own.alias("copies"))


def sizes_of(docs: DataFrame) -> DataFrame:
    return stage_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size")), "sizes")


def take_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it.

    Only doc_id, source and size go through the mix; texts meet their copies in
    one join. Rows that share all three are counted as whole rows and get their
    share in the order of a hash.
    """
    size, i, s, z, n, copies, at, same, before = free_names(docs.columns, "size", "i", "s", "z", "n", "copies", "at", "same", "before")
    mixed = stage_table(mix_documents(sizes_of(docs)).select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z), F.col("n_rows").alias(n), F.col("copies").alias(copies)).filter(F.col(copies) > 0), "copies")
    key = (F.col("doc_id").cast("long").eqNullSafe(F.col(i))) & (F.col("source").eqNullSafe(F.col(s))) & (F.col(size) == F.col(z))
    sized = docs.withColumn(size, n_words(F.col("text")))
    single = sized.join(mixed.filter(F.col(n) == 1), key).withColumn(copies, F.col(copies).cast("long"))
    # equal rows are one row with their number, so only different ones are put in order
    repeated = sized.join(mixed.filter(F.col(n) > 1), key).groupBy(*docs.columns, i, s, z, n, copies).agg(F.count(F.lit(1)).alias(same))
    order = Window.partitionBy(i, s, z).orderBy(F.xxhash64(*docs.columns), *(c for c in ("text",) if c in docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(copies) % F.col(n)
    more = F.least(F.col(before) + F.col(same), left) - F.least(F.col(before), left)
    repeated = repeated.withColumn(before, F.coalesce(F.sum(same).over(order), F.lit(0))).withColumn(copies, F.floor(F.col(copies) / F.col(n)) * F.col(same) + more)
    rows = single.select(*docs.columns, copies).unionByName(repeated.select(*docs.columns, copies))
    return times(F.col(copies), at, rows).select(*docs.columns)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sizes(sizes_of(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
