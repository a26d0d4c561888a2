"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import shared_dir, stage_table

__all__ = ["BATCH_BYTES", "WORD_GAP", "claim", "free_names", "give_back", "let", "map_arrow", "running", "shared_dir", "small", "split_words", "stage_table", "table", "words_of"]

#: Separators of words: space and U+0009 to U+000D.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Most bytes of an Arrow batch, unless a single row has more.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

#: Most rows of a table of keys, some 40 bytes each, that is broadcast rather than whole texts being shuffled to it.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of short rows, marked for broadcast if it is counted to have at most ``rows``; joins with larger ones shuffle."""
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the columns has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes, so that long texts don't make a batch that outgrows a worker.

    The bound becomes a setting of the session, as plans read it when they run.
    """
    df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, even where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` makes of zero and all values before each one.

    Appending to an array copies it, so values go in pieces of the square root of their number.
    """
    kind = "array<bigint>"

    def fold(piece: Column, start: Column) -> Column:
        first = F.struct(start.cast("long").alias("at"), F.array().cast(kind).alias("all"))
        go = lambda acc, v: F.struct(step(acc["at"], v).cast("long").alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
        return F.aggregate(piece, first, go)

    def of(x: Column) -> Column:
        n = F.size(x)
        return let(F.ceil(F.sqrt(n)).cast("int"), lambda width: in_pieces(x, n, width))

    def in_pieces(x: Column, n: Column, width: Column) -> Column:
        places = F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1)
        piece = lambda k: F.slice(x, k * width + 1, width)
        totals = F.transform(places, lambda k: F.aggregate(piece(k), zero.cast("long"), lambda a, v: step(a, v).cast("long")))
        starts = fold(totals, zero)["all"]
        return let(starts, lambda s: F.flatten(F.transform(places, lambda k: fold(piece(k), F.get(s, k))["all"])))

    return let(values, lambda x: F.when(F.size(x) <= 16, fold(x, zero)["all"]).otherwise(of(x)))


def words_of(text: Column) -> Column:
    """The words of a text, in order; none of a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def split_words(text: str) -> list[str]:
    """Python twin of words_of; may hold empty strings between two gaps."""
    for gap in "\t\n\x0b\x0c\r":
        if gap in text:
            text = text.replace(gap, " ")
    return text.split(" ")


_caches: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Hands memory that this process has freed back to the system, which else stays with idle Python workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Tell a Python worker which operator runs now; what other operators remembered there is forgotten."""
    others = [n for n in _caches if n != owner]
    for name in others:
        _caches.pop(name)()
    if others:
        give_back()
    _caches[owner] = clear
