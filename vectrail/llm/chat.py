"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a table, or of each JSON record, are hashed; the
fingerprint selects a declared mapping to canonical turns, an array of (role,
text). Turns are rendered with marks, control strings inside texts being
escaped so that no text can form a mark, and ``read_back`` parses the rendered
string into the same turns.

Escaping puts one backslash after the first character of a control string;
control strings that already hold backslashes there get one more, so removing
one from each undoes it exactly.

Defined results: null roles and texts are empty; turns with equal number are
ordered by role, then text, nulls first; a null turn comes first; repeated rows
are turns of their own; an empty table gives an empty result; columns that the
chosen layout doesn't know are ignored, whatever their names. A record whose
fingerprint has no mapping gets null turns. Very long texts are rendered whole.
One conversation is one row, so a conversation has to fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, running, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of common chat templates: one of two first characters, then one of these.
_TAIL = r"/?s>|/?INST\]|</?SYS>>|\|"
_ESCAPE = rf"([<\[])(\\*)({_TAIL})"
_UNESCAPE = rf"([<\[])(\\*)\\({_TAIL})"
LEARNED_ROLE = "assistant"
TURNS_TYPE = "array<struct<role:string,text:string>>"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, _ESCAPE, r"$1$2\\$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, _UNESCAPE, "$1$2$3")


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves, with [] for array elements, sorted."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else _text(role)).alias("role"), _text(text).alias("text"))


def _list(name: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    names = {"human": "user", "gpt": "assistant", "bot": "assistant"}

    def known(r: Column) -> Column:
        out = F.when(F.lit(False), r)
        for old, new in names.items():
            out = out.when(r == old, F.lit(new))
        return out.otherwise(r)

    return lambda get: F.transform(get(name), lambda m: _turn(known(m[role]), m[text]))


def _pair(prompt: str, reply: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda get: F.array(_turn("user", get(prompt)), _turn("assistant", get(reply)))


def _instruction(get: Callable[[str], Column]) -> Column:
    more = _text(get("input"))
    ask = F.concat(_text(get("instruction")), F.when(more == "", "").otherwise(F.concat(F.lit("\n\n"), more)))
    return F.array(_turn("user", ask), _turn("assistant", get("output")))


def turns_of_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, turns for one row a turn."""
    turn = F.struct("turn", "role", "text")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select(F.col("conv_id").alias(key), F.transform("t", lambda x: _turn(x["role"], x["text"])).alias("turns"))


def record(mapping: Callable[[Callable[[str], Column]], Column]) -> Callable[[DataFrame, str], DataFrame]:
    """The layout of one row a conversation, with a mapping from its fields to turns."""
    return lambda df, key: df.select(key, F.coalesce(mapping(F.col), F.array().cast(TURNS_TYPE)).alias("turns"))


#: Layouts of one record: leaf paths -> mapping to turns. Each mapping gets a function from field name to Column.
RECORDS: dict[tuple[str, ...], Callable[[Callable[[str], Column]], Column]] = {
    ("messages[].content", "messages[].role"): _list("messages", "role", "content"),
    ("conversations[].from", "conversations[].value"): _list("conversations", "from", "value"),
    ("prompt", "response"): _pair("prompt", "response"),
    ("completion", "prompt"): _pair("prompt", "completion"),
    ("answer", "question"): _pair("question", "answer"),
    ("instruction", "output"): _pair("instruction", "output"),
    ("input", "instruction", "output"): _instruction,
}
#: The layout of one row a turn.
ROW_LAYOUT = ("conv_id", "role", "text", "turn")
#: All layouts of tables: leaf paths -> function of a table and its key.
LAYOUTS: dict[tuple[str, ...], Callable[[DataFrame, str], DataFrame]] = {ROW_LAYOUT: turns_of_rows} | {paths: record(mapping) for paths, mapping in RECORDS.items()}
#: The type of each field that arrays of JSON records have.
_JSON_TYPES = {
    "messages": "array<struct<role:string,content:string>>",
    "conversations": "array<struct<from:string,value:string>>",
}


def layout_of(paths: list[str]) -> tuple[str, ...] | None:
    """The layout whose fingerprint the paths have, or else that they have without paths that the layout doesn't know; of several the one with most paths, then the first."""
    by_print = {fingerprint(list(k)): k for k in LAYOUTS}
    for some in (paths, *([p for p in paths if p in k] for k in sorted(LAYOUTS, key=len, reverse=True))):
        if (found := by_print.get(fingerprint(some))) is not None:
            return found
    return None


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: the mapping is chosen by the fingerprint of the table's field paths."""
    paths = field_paths(df.schema)
    layout = layout_of(paths)
    if layout is None:
        raise ValueError(f"no layout has the paths {paths}")
    return LAYOUTS[layout](df, key)


def canonical_records(df: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """key, fingerprint, turns for JSON records that may each have another layout; null turns where none fits."""
    value = F.try_parse_json(F.col(record))
    shape = F.schema_of_variant(value)
    # OBJECT<a: STRING, m: ARRAY<OBJECT<x: STRING>>>: types of leaves don't matter to the fingerprint
    shape = F.regexp_replace(F.regexp_replace(shape, r": (?!OBJECT|ARRAY)[A-Z]+(\([0-9,]+\))?", ""), r"<(STRING|VOID|BIGINT|BOOLEAN|DOUBLE)>", "<>")

    def as_shape(paths: tuple[str, ...]) -> str:
        if "[]." not in paths[0]:
            return "OBJECT<" + ", ".join(sorted(paths)) + ">"
        name = paths[0].split("[]")[0]
        return f"OBJECT<{name}: ARRAY<OBJECT<{', '.join(sorted(p.split('[].')[1] for p in paths))}>>>"

    get = lambda name: F.try_variant_get(value, f"$.{name}", _JSON_TYPES.get(name, "string"))
    turns = F.when(F.lit(False), F.lit(None).cast(TURNS_TYPE))
    for paths, mapping in RECORDS.items():
        turns = turns.when(F.col("fingerprint") == hashlib.sha256(as_shape(paths).encode()).hexdigest(), mapping(get))
    return df.withColumn("fingerprint", F.sha2(shape, 256)).select(key, "fingerprint", turns.alias("turns"))


def render(turns: Column) -> Column:
    """The formatted string."""
    one = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(SAYS), escape(t["text"]), F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(turns: Column) -> Column:
    """(start, length) in code points of each learned text in the formatted string, escapes included."""
    sized = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.length(escape(t["role"])).cast("long").alias("head"), F.length(escape(t["text"])).cast("long").alias("length")))

    def of(x: Column, at: Column) -> Column:
        def span(t: Column, i: Column) -> Column:
            return F.when(t["role"] == LEARNED_ROLE, F.struct((F.get(at, i) + t["head"] + len(TURN) + len(SAYS)).alias("start"), t["length"].alias("length")))

        return F.filter(F.transform(x, span), lambda s: s.isNotNull())

    def starts(x: Column) -> Column:
        return running(F.transform(x, lambda t: t["head"] + t["length"] + len(TURN) + len(SAYS) + len(END)), F.lit(0), lambda at, n: at + n)

    return let(sized, lambda x: let(starts(x), lambda at: of(x, at)))


def read_back(formatted: Column) -> Column:
    """Turns of a formatted string."""
    def one(x: Column) -> Column:
        halves = F.split(x, r"<\|says\|>", -1)
        return F.struct(unescape(halves[0]).alias("role"), unescape(F.regexp_replace(halves[1], r"<\|end\|>$", "")).alias("text"))

    return F.transform(F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x, i: i > 0), one)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    part = lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(spans, part), "")


def format_chats(canonical: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` to rows with ``turns``."""
    return canonical.withColumn("formatted", render(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("turns")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(own).alias("text")) for k, r in enumerate(("user", "assistant"))))).alias("t")).select("conv_id", "t.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = format_chats(canonical_turns(rows))
    all_text = lambda turns: F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = let(read_back(F.col("formatted")), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.sha2(all_text(t), 256).alias("h")))
    loss = let(under_mask(F.col("formatted"), F.col("loss_spans")), lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("h")))
    return done.select("conv_id", turns.alias("t"), loss.alias("l"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", F.col("t.n").alias("n_turns"), F.col("t.h").alias("turns_sha256"), F.col("l.n").alias("loss_chars"), F.col("l.h").alias("loss_sha256"), "formatted_chars"
    )


_E = r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|)"
OP5_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT conv_id, turn AS k1, role AS k2, text AS k3, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
g AS (
  SELECT conv_id, count(*) AS n,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY k1 NULLS FIRST, k2 NULLS FIRST, k3 NULLS FIRST) AS t,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k1 NULLS FIRST, k2 NULLS FIRST, k3 NULLS FIRST), '') AS l,
         sum({len(TURN + SAYS + END)} + length(regexp_replace(role, '{_E}', '\1\2\\\3', 'g')) + length(regexp_replace(text, '{_E}', '\1\2\\\3', 'g'))) AS f
  FROM r GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(t) AS turns_sha256, CAST(length(l) AS BIGINT) AS loss_chars,
       sha256(l) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars
FROM g
"""
