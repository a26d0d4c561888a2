"""JSON metadata filters: parse a query document into a tree, compile the tree to a Column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stage_table

MAX_DEPTH = 2
COMPARE = ("$eq", "$ne", "$lt", "$lte", "$gt", "$gte")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """op: and, or, not, or one of COMPARE with field and value."""

    op: str
    kids: tuple = ()
    path: str = ""
    value: object = field(default=None)

    def __str__(self) -> str:
        if self.op in COMPARE:
            return f"{self.path} {self.op[1:]} {self.value!r}"
        return f"{self.op}({', '.join(map(str, self.kids))})"


def parse(query: dict, depth: int = 0) -> Node:
    """The tree of a filter. Keys beside $and, $or or $not are ignored, and so are fields whose condition isn't an object."""
    if depth > MAX_DEPTH:
        raise FilterError(f"filters nest at most {MAX_DEPTH} deep")
    if not isinstance(query, dict):
        raise FilterError("a filter must be an object")
    for op in ("$and", "$or"):
        if op in query:
            if not isinstance(query[op], list) or not query[op]:
                raise FilterError(f"{op} needs a list with a filter in it")
            return Node(op[1:], tuple(parse(x, depth + 1) for x in query[op]))
    if "$not" in query:
        return Node("not", (parse(query["$not"], depth + 1),))
    kids = []
    for path, condition in query.items():
        if path.startswith("$"):
            raise FilterError(f"unknown operator {path}")
        if not isinstance(condition, dict):
            continue
        for op, value in condition.items():
            if op not in COMPARE:
                raise FilterError(f"unknown operator {op}")
            if op in COMPARE[2:] and (isinstance(value, bool) or not isinstance(value, (int, float))):
                raise FilterError(f"{op} needs a number")
            kids.append(Node(op, path=path, value=value))
    if not kids:
        raise FilterError("no condition")
    return kids[0] if len(kids) == 1 else Node("and", tuple(kids))


def compile_filter(node: Node, document: Column) -> Column:
    """A Column that is never null: a missing field makes each comparison false, before any negation."""
    if node.op in ("and", "or"):
        out = compile_filter(node.kids[0], document)
        for kid in node.kids[1:]:
            other = compile_filter(kid, document)
            out = out & other if node.op == "and" else out | other
        return out
    if node.op == "not":
        return ~compile_filter(node.kids[0], document)
    return F.coalesce(_compare(node, document), F.lit(False))


def _compare(node: Node, document: Column) -> Column:
    path = "$" + "".join(f"['{p}']" for p in node.path.split("."))
    got = F.try_variant_get(document, path, "variant")
    kind = F.schema_of_variant(got)
    if node.op in COMPARE[2:]:
        number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(document, path, "double"))
        v = F.lit(float(node.value))
        return {"$lt": number < v, "$lte": number <= v, "$gt": number > v, "$gte": number >= v}[node.op]
    if isinstance(node.value, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(document, path, "boolean") == node.value)
    elif isinstance(node.value, int):
        same = (kind == "BIGINT") & (F.try_variant_get(document, path, "bigint") == node.value)
    elif isinstance(node.value, float):
        same = kind.rlike("^(DOUBLE|DECIMAL)") & (F.try_variant_get(document, path, "double") == node.value)
    elif isinstance(node.value, str):
        same = (kind == "STRING") & (F.try_variant_get(document, path, "string") == node.value)
    else:
        raise FilterError("values are booleans, numbers or strings")
    present = F.when(got.isNotNull(), F.coalesce(same, F.lit(False)))
    return present if node.op == "$eq" else ~present


def matches(df: DataFrame, query: dict, json_column: str) -> DataFrame:
    """Rows whose JSON document passes the filter."""
    return df.filter(compile_filter(parse(query), F.try_parse_json(F.col(json_column))))


def visit(node: Node, leave) -> object:
    """Folds a tree from below: ``leave(node, results of its kids)`` for every node."""
    return leave(node, [visit(kid, leave) for kid in node.kids])


def flatten(df: DataFrame, key: str, json_column: str, separator: str = ".", arrays: bool = True) -> DataFrame:
    """(key, path, value, kind): the leaves of each document, however deep; elements of arrays have their places in paths, or arrays are leaves."""
    value = F.try_parse_json(F.col(json_column))
    rows = stage_table(df.select(key, F.lit(None).cast("string").alias("path"), value.alias("v")).filter("v is not null"), "documents")
    leaves = None
    opened = r"^(OBJECT|ARRAY)" if arrays else r"^OBJECT"
    while not rows.isEmpty():
        step = rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(key, F.concat_ws(separator, F.col("path"), F.coalesce("key", F.col("pos").cast("string"))).alias("path"), F.col("value").alias("v"))
        step = step.withColumn("kind", F.schema_of_variant("v"))
        inner = F.coalesce(F.col("kind").rlike(opened), F.lit(False))
        step = stage_table(step, "leaves")
        leaf = step.filter(~inner).select(key, "path", F.col("v").cast("string").alias("value"), "kind")
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        rows = step.filter(inner).drop("kind")
    if leaves is None:
        return rows.select(key, "path", F.col("v").cast("string").alias("value"), F.lit(None).cast("string").alias("kind"))
    return leaves


def posting_lists(attributes: DataFrame, key: str) -> DataFrame:
    """(path, value, ids, n): the documents of each attribute value."""
    return attributes.groupBy("path", "value").agg(F.sort_array(F.collect_set(key)).alias("ids"), F.countDistinct(key).alias("n"))


def insert_postings(attributes: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Attributes with those of new documents; a document that is there already is an error."""
    again = more.select(key).distinct().join(attributes.select(key).distinct(), key).limit(1)
    if not again.isEmpty():
        raise FilterError(f"document {again.first()[0]} is there already")
    return attributes.unionByName(more)


def delete_postings(attributes: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return attributes.join(ids.select(key).distinct(), key, "left_anti")


def postings(attributes: DataFrame, node: Node, key: str) -> DataFrame:
    """Document ids by set operations on postings. As a posting list knows no absent values, not and $ne are refused.

    Equality is that of typed values where attributes have a ``kind``: the
    number 42 is neither the text "42" nor 42.0.
    """
    if node.op in ("and", "or"):
        out = postings(attributes, node.kids[0], key)
        for kid in node.kids[1:]:
            more = postings(attributes, kid, key)
            out = out.intersect(more) if node.op == "and" else out.union(more).distinct()
        return out
    if node.op in ("not", "$ne"):
        raise FilterError(f"posting lists can't answer {node.op}")
    v, number = F.col("value"), F.col("value").try_cast("double")
    kinds = {bool: "^BOOLEAN", int: "^BIGINT", float: "^(DOUBLE|DECIMAL)", str: "^STRING"}
    typed = "kind" in attributes.columns
    if node.op == "$eq":
        want = node.value
        same = number == F.lit(want) if isinstance(want, float) else v == F.lit(str(want).lower() if isinstance(want, bool) else str(want))
        test = same & F.col("kind").rlike(kinds[type(want)]) if typed else same
    else:
        test = {"$lt": number < F.lit(node.value), "$lte": number <= F.lit(node.value), "$gt": number > F.lit(node.value), "$gte": number >= F.lit(node.value)}[node.op]
        if typed:
            test = test & F.col("kind").rlike("^(BIGINT|DOUBLE|DECIMAL)")
    return attributes.filter((F.col("path") == node.path) & F.coalesce(test, F.lit(False))).select(key).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference of two posting sets."""
    return a.subtract(b)


def bitmap(df: DataFrame, queries: list[tuple[int, dict]], key: str, json_column: str) -> DataFrame:
    """(query_id, key): the documents that pass each query's filter, in one pass. A query id that occurs twice is an error."""
    ids = [q for q, _ in queries]
    if len(set(ids)) < len(ids):
        raise FilterError("a query id occurs twice")
    document = F.try_parse_json(F.col(json_column))
    passed = F.array(*(F.when(compile_filter(parse(f), document), F.lit(q).cast("bigint")) for q, f in queries))
    return df.select(F.explode(F.filter(passed, lambda q: q.isNotNull())).alias("query_id"), key)


def specificity(df: DataFrame, queries: dict[int, dict], json_column: str) -> DataFrame:
    """query_id, matches, specificity for a few filters, in one pass."""
    document = F.try_parse_json(F.col(json_column))
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(compile_filter(parse(q), document)).alias(f"m{i}") for i, q in queries.items()))
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("query_id"), F.col(f"m{i}").alias("matches")) for i in queries)))
    return counts.select("n", each.alias("s")).select("s.query_id", "s.matches", (F.col("s.matches") / F.col("n")).alias("specificity"))
