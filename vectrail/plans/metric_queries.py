"""Queries of filters, search metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import filters as J
from ..operators import metrics as M
from ..operators import nearest as N
from ..operators import reports as R
from ..operators import search as S
from ..sources import vectors as files
from ..sources.tables import stage_table
from .search_queries import IP, K, all_distances, base, dist_sql, embeddings, queries, top_sql

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- filters over events.props, documents like {"k": 87}

def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value", "props")


_KJ = "try_cast(json_extract_string(props, '$.k') AS DOUBLE)"
for _name, _filter, _where in (
    ("filter_and_or_not", {"$and": [{"k": {"$gte": 20}}, {"$or": [{"k": {"$lt": 40}}, {"k": {"$gt": 90}}]}]}, "k >= 20 AND (k < 40 OR k > 90)"),
    ("filter_not", {"$not": {"k": {"$gt": 50}}}, "NOT coalesce(k > 50, false)"),
    ("filter_missing_field", {"$not": {"missing.part": {"$gt": 50}}}, "true"),
    ("filter_ne", {"k": {"$ne": 7}}, "coalesce(k <> 7, false)"),
    ("filter_ne_missing", {"missing": {"$ne": 7}}, "false"),
    ("filter_range", {"k": {"$gt": 10, "$lte": 30}}, "k > 10 AND k <= 30"),
    ("filter_eq_int", {"k": {"$eq": 42}}, "k = 42"),
    ("filter_eq_float_is_not_int", {"k": {"$eq": 42.0}}, "false"),
):
    QUERIES[_name] = lambda spark, d, f=_filter: J.matches(events(spark, d), f, "props").select("event_id", "props")
    SQL[_name] = f"SELECT event_id, props FROM (SELECT *, {_KJ} AS k FROM events) WHERE {_where}"


@query("SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten(spark, d):
    return J.flatten(events(spark, d), "event_id", "props").drop("kind")


@query("SELECT event_id, unnest(['a/b/c/d/e', 'list/0', 'list/1/x']) AS path, unnest([CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), event_type]) AS value FROM events")
def json_flatten_deep(spark, d):
    e = events(spark, d)
    nested = F.format_string('{"a":{"b":{"c":{"d":{"e":%d}}}},"list":[%d,{"x":"%s"}]}', "event_id", "user_id", "event_type")
    return J.flatten(e.withColumn("doc", nested), "event_id", "doc", "/").drop("kind")


@query(f"SELECT 1 AS query_id, event_id FROM events WHERE {_KJ} < 10 UNION ALL SELECT 2, event_id FROM events WHERE {_KJ} >= 50 AND {_KJ} < 60 UNION ALL SELECT 3, event_id FROM events WHERE NOT coalesce({_KJ} > 5, false)")
def filter_bitmap(spark, d):
    return J.bitmap(events(spark, d), [(1, {"k": {"$lt": 10}}), (2, {"k": {"$gte": 50, "$lt": 60}}), (3, {"$not": {"k": {"$gt": 5}}})], "event_id", "props")


@query(f"SELECT event_id FROM events WHERE {_KJ} < 50 AND NOT ({_KJ} = 7) AND event_id % 10 <> 0")
def posting_difference(spark, d):
    """After the documents of every tenth id are deleted."""
    a = J.flatten(events(spark, d), "event_id", "props")
    a = J.delete_postings(a, events(spark, d).filter("event_id % 10 = 0").select("event_id"), "event_id")
    return J.without(J.postings(a, J.parse({"k": {"$lt": 50}}), "event_id"), J.postings(a, J.parse({"k": {"$eq": 7}}), "event_id"))


@query("SELECT 'k' AS path, json_extract_string(props, '$.k') AS value, list_sort(list_distinct(list(event_id))) AS ids, count(DISTINCT event_id) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY ALL")
def posting_list_build(spark, d):
    return J.posting_lists(J.flatten(events(spark, d), "event_id", "props"), "event_id")


def attributes(spark, d):
    e = events(spark, d)
    kind = e.select("event_id", F.lit("type").alias("path"), F.col("event_type").alias("value"), F.lit("STRING").alias("kind"))
    return J.flatten(e, "event_id", "props").unionByName(kind)


@query(f"SELECT event_id FROM events WHERE {_KJ} < 30 AND event_type = (SELECT min(event_type) FROM events)")
def posting_and(spark, d):
    first = events(spark, d).agg(F.min("event_type")).first()[0]
    return J.postings(attributes(spark, d), J.parse({"$and": [{"k": {"$lt": 30}}, {"type": {"$eq": first}}]}), "event_id")


@query(f"SELECT event_id FROM events WHERE {_KJ} < 10 OR {_KJ} >= 95")
def posting_or(spark, d):
    return J.postings(attributes(spark, d), J.parse({"$or": [{"k": {"$lt": 10}}, {"k": {"$gte": 95}}]}), "event_id")


@query(f"""WITH e AS (SELECT {_KJ} AS k FROM events), s AS (SELECT unnest([{{'q': 0, 'm': count_if(k < 10)}}, {{'q': 1, 'm': count_if(k >= 50)}}, {{'q': 2, 'm': count_if(k = 7)}}]) AS s, count(*) AS n FROM e)
SELECT CAST(s.q AS BIGINT) AS query_id, CAST(s.m AS BIGINT) AS matches, round(s.m / n, 9) AS specificity FROM s""")
def specificity_per_filter(spark, d):
    got = J.specificity(events(spark, d), {0: {"k": {"$lt": 10}}, 1: {"k": {"$gte": 50}}, 2: {"k": {"$eq": 7}}}, "props")
    return got.withColumn("specificity", F.round("specificity", 9))


@query(f"""WITH e AS (SELECT {_KJ} AS k FROM events), r AS (SELECT unnest([count_if(k < 10), count_if(k >= 50), count_if(k = 7)]) / count(*) AS s FROM e)
SELECT round(avg(s), 9) AS mean, round(median(s), 9) AS median, round(min(s), 9) AS least, round(max(s), 9) AS most FROM r""")
def specificity_stats(spark, d):
    s = specificity_per_filter(spark, d)
    return s.agg(*(F.round(f("specificity"), 9).alias(n) for f, n in ((F.avg, "mean"), (F.median, "median"), (F.min, "least"), (F.max, "most"))))


@query("SELECT d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.lang = 'en'")
def text_label_filter(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("lang = 'en'").select("doc_id", "lang")
    return docs.join(spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1"), "doc_id", "left_semi")


# ---- metrics: results are what a search over labels other than 0 finds, truth is the whole search

def truth(spark, d, k=K):
    """Written, as most metrics read it more than once."""
    return stage_table(S.knn(queries(spark, d), base(spark, d), k, own=False), "truth")


def results(spark, d, k=K):
    return stage_table(S.knn(queries(spark, d), base(spark, d).filter("label <> 0"), k, own=False), "results")


def rough(spark, d, k, where="true"):
    """Top k by the distance rounded to one digit."""
    return S.knn_by_key(queries(spark, d), base(spark, d).filter(where), k, N.rounded(1), own=False)


TR = f"{dist_sql()}, t AS ({top_sql()}), r AS ({top_sql(source='(SELECT * FROM d WHERE label <> 0)')})"
HIT = "SELECT r.* FROM r JOIN t USING (query_id, vec_id)"


@query(f"WITH {TR} SELECT count(*) AS hits, count(*) / (10.0 * (SELECT count(DISTINCT query_id) FROM t)) AS recall FROM ({HIT})")
def recall_simple(spark, d):
    return M.recall(results(spark, d), truth(spark, d), K)


@query(f"""WITH {TR}, w AS (SELECT query_id, vec_id FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY dist) AS rr FROM t) WHERE rr <= 5)
SELECT query_id, CAST(least(count(r.vec_id), 5) AS BIGINT) AS hits, least(count(r.vec_id), 5) / 5.0 AS recall FROM w LEFT JOIN r USING (query_id, vec_id) GROUP BY query_id""")
def recall_ties(spark, d):
    return M.recall_with_ties(results(spark, d), truth(spark, d), 5, K)


@query(f"""WITH {TR}, w AS (SELECT query_id, vec_id, count(*) OVER (PARTITION BY query_id) AS n FROM t WHERE dist <= 1.55)
SELECT query_id, count(r.vec_id) AS hits, round(count(r.vec_id) / max(n), 9) AS recall FROM w LEFT JOIN r USING (query_id, vec_id) GROUP BY query_id""")
def recall_flexible(spark, d):
    t = truth(spark, d).filter("dist <= 1.55")
    hits = t.join(results(spark, d).select("query_id", "vec_id", F.lit(1).alias("h")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.count("h").alias("hits"), F.round(F.count("h") / F.count(F.lit(1)), 9).alias("recall"))


@query(f"""WITH {TR}, ft AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS fr FROM d WHERE label = 2 AND dist <= 1.7),
fr AS (SELECT query_id, vec_id FROM r WHERE label = 2),
c AS (SELECT q.query_id, (SELECT count(*) FROM ft WHERE ft.query_id = q.query_id) AS tt, (SELECT count(*) FROM fr WHERE fr.query_id = q.query_id) AS rr,
 (SELECT count(*) FROM fr JOIN ft USING (query_id, vec_id) WHERE fr.query_id = q.query_id AND ft.fr <= 10) AS hh FROM q)
SELECT query_id, round(CASE WHEN tt = 0 THEN 100.0 ELSE 100.0 * hh / greatest(least(10, tt), rr) END, 6) AS recall FROM c""")
def recall_filtered(spark, d):
    t = S.top_k(S.pairs_within(queries(spark, d), base(spark, d).filter("label = 2"), 1.7, own=False), 1 << 30)
    got = M.filtered_recall(results(spark, d).filter("label = 2"), t, queries(spark, d), K)
    return got.withColumn("recall", F.round("recall", 6))


@query(f"WITH {TR} SELECT round((SELECT count(*) FROM r JOIN d USING (query_id, vec_id) WHERE d.dist <= 1.6) / (SELECT count(*) FROM d WHERE dist <= 1.6), 9) AS average_precision")
def average_precision(spark, d):
    got = M.average_precision_counted(results(spark, d), S.count_within(queries(spark, d), base(spark, d), 1.6, own=False), 1.6)
    return got.withColumn("average_precision", F.round("average_precision", 9))


def _approx(spark, d):
    return truth(spark, d).withColumn("approx", F.round("dist", 2))


for _name, _floor, _below, _else in (("rel_error_skip", 1e-6, "skip", "NULL"), ("rel_error_zero", 1.5, "zero", "0.0")):
    QUERIES[_name] = lambda spark, d, fl=_floor, b=_below: M.error_summary(_approx(spark, d), M.relative_error(F.col("approx"), F.col("dist"), fl, b)).select(F.round("mean_error", 9).alias("mean_error"), F.round("p95_error", 9).alias("p95_error"))
    SQL[_name] = f"WITH {TR}, e AS (SELECT CASE WHEN dist > {_floor} THEN abs(round(dist, 2) - dist) / dist ELSE {_else} END AS e FROM t) SELECT round(avg(e), 9) AS mean_error, round(quantile_disc(e, 0.95), 9) AS p95_error FROM e"


@query(f"WITH {TR}, a AS (SELECT query_id, rank, round(dist, 2) + 0.01 * (vec_id % 3) AS a FROM t) SELECT round(avg(CASE WHEN x.a > y.a THEN 1.0 ELSE 0.0 END), 9) AS flip_rate FROM a x JOIN a y ON x.query_id = y.query_id AND x.rank < y.rank")
def flip_rate_pairs(spark, d):
    a = truth(spark, d).select("query_id", F.col("rank").alias("pos"), F.col("dist").alias("exact"), (F.round("dist", 2) + F.lit(0.01) * (F.col("vec_id") % 3)).alias("approx"))
    return M.flip_rate(a).select(F.round("flip_rate", 9).alias("flip_rate"))


@query(f"""WITH {dist_sql()}, t AS ({top_sql()}), g AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 1), vec_id) AS rb FROM d QUALIFY rb <= 10),
j AS (SELECT query_id, rank AS ra, rb FROM t JOIN g USING (query_id, vec_id)) SELECT round(avg(CASE WHEN x.rb > y.rb THEN 1.0 ELSE 0.0 END), 9) AS flip_rate FROM j x JOIN j y ON x.query_id = y.query_id AND x.ra < y.ra""")
def flip_rate_ranks(spark, d):
    return M.flip_rate_ranks(truth(spark, d), rough(spark, d, K)).select(F.round("flip_rate", 9).alias("flip_rate"))


@query(f"""WITH {dist_sql(where="vec_id % 5 = 0")}, t AS ({top_sql()}), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 1), vec_id) AS rb FROM d QUALIFY rb <= 10)
SELECT count(*) AS hits, count(*) / (10.0 * (SELECT count(DISTINCT query_id) FROM t)) AS recall FROM f JOIN t USING (query_id, vec_id)""")
def fixed_candidate_recall(spark, d):
    t = stage_table(S.knn(queries(spark, d), base(spark, d).filter("vec_id % 5 = 0"), K, own=False), "truth")
    return M.recall(rough(spark, d, K, "vec_id % 5 = 0"), t, K)


@query("SELECT round(avg(value), 6) AS mean_us, round(quantile_cont(value, 0.5), 6) AS p50_us, round(quantile_cont(value, 0.95), 6) AS p95_us, round(quantile_cont(value, 0.99), 6) AS p99_us, round(count(value) * 1e6 / sum(value), 4) AS qps FROM events")
def latency_stats(spark, d):
    s = M.latency_stats(events(spark, d), "value")
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns[:4]), F.round("qps", 4).alias("qps"))


@query(f"WITH {dist_sql()}, t AS ({top_sql()}) SELECT round(avg(x / y), 6) AS relative_contrast FROM (SELECT query_id, avg(dist) AS x FROM d GROUP BY 1) JOIN (SELECT query_id, avg(dist) AS y FROM t GROUP BY 1) USING (query_id)")
def relative_contrast(spark, d):
    return M.relative_contrast(all_distances(spark, d), truth(spark, d)).select(F.round("relative_contrast", 6).alias("relative_contrast"))


_DIMS = "x AS (SELECT unnest(generate_series(0, 63)) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings), s AS (SELECT CAST(dim AS BIGINT) AS dim, avg(x) AS mean, var_pop(x) AS variance FROM x GROUP BY dim)"


@query(f"WITH {_DIMS} SELECT dim, round(mean, 6) AS mean, round(variance, 6) AS variance FROM s")
def dim_stats(spark, d):
    return M.dim_stats(embeddings(spark, d).withColumnRenamed("embedding", "vec")).select("dim", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


_MEDOID = f"WITH {_DIMS}, q AS (SELECT list(mean ORDER BY dim) AS v FROM s), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


@query(_MEDOID + " SELECT vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: (q.v[i] - b.v[i]) * (q.v[i] - b.v[i]))), 6) AS dist FROM q, b ORDER BY list_sum(list_transform(generate_series(1, 64), lambda i: (q.v[i] - b.v[i]) * (q.v[i] - b.v[i]))), vec_id LIMIT 1")
def medoid(spark, d):
    e = embeddings(spark, d).select("vec_id", F.col("embedding").alias("vec"))
    near = S.top_k(S.distances(M.centroid(e), e), 1)
    return near.select("vec_id", F.round("dist", 6).alias("dist"))


# ---- reports: runs derived from lineitem

def runs(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.col("l_returnflag").alias("method"), (F.col("l_suppkey") % 7).cast("string").alias("config_id"), (F.col("l_linenumber") % 3).cast("bigint").alias("repeat_id"), "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"),
                     (F.col("l_quantity") / 50.0).cast("double").alias("recall"), F.col("l_extendedprice").cast("double").alias("qps"))


RUNS = "runs AS (SELECT l_returnflag AS method, CAST(l_suppkey % 7 AS VARCHAR) AS config_id, CAST(l_linenumber % 3 AS BIGINT) AS repeat_id, l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity / 50.0 AS DOUBLE) AS recall, CAST(l_extendedprice AS DOUBLE) AS qps FROM lineitem)"


@query(f"WITH {RUNS} SELECT method, config_id, repeat_id, recall, qps FROM (SELECT *, row_number() OVER (PARTITION BY method, config_id, repeat_id ORDER BY l_orderkey, line, qps, recall) AS r FROM runs) WHERE r = 1")
def dedup_runs(spark, d):
    return R.dedup_first(runs(spark, d), ["method", "config_id", "repeat_id"], ["l_orderkey", "line", "qps", "recall"]).select("method", "config_id", "repeat_id", "recall", "qps")


@query(f"WITH {RUNS}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, config_id, repeat_id ORDER BY l_orderkey, line, qps, recall) AS r FROM runs) WHERE r = 1) SELECT method, config_id, round(median(recall), 6) AS recall, round(median(qps), 6) AS qps, arg_min(l_orderkey, repeat_id) AS l_orderkey, count(*) AS repeats FROM u GROUP BY ALL")
def median_runs(spark, d):
    one = R.dedup_first(runs(spark, d), ["method", "config_id", "repeat_id"], ["l_orderkey", "line", "qps", "recall"])
    m = R.median_runs(one, ["method", "config_id"], ["recall", "qps"], ["l_orderkey"], F.col("repeat_id"))
    return m.withColumns({c: F.round(c, 6) for c in ("recall", "qps")})


@query(f"WITH {RUNS} SELECT method, config_id, round(stddev_pop(qps) / avg(qps), 6) AS cv, stddev_pop(qps) / avg(qps) <= 0.5 AS passed FROM runs GROUP BY ALL")
def cv_gate(spark, d):
    return R.cv_gate(runs(spark, d), ["method", "config_id"], "qps", 0.5).withColumn("cv", F.round("cv", 6))


_FRONT = "b AS (SELECT method, round(recall, 10) AS recall, max(qps) AS qps FROM runs GROUP BY ALL), f AS (SELECT *, max(qps) OVER (PARTITION BY method ORDER BY recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b)"


@query(f"WITH {RUNS}, {_FRONT} SELECT method, recall, qps FROM f WHERE m IS NULL OR qps > m")
def pareto_frontier(spark, d):
    return R.pareto_front(runs(spark, d), "recall", "qps", ["method"])


def _interpolation(best: bool) -> str:
    last = "AND recall >= target - 1e-9" if best else ""
    return f"""WITH {RUNS}, b AS (SELECT method, recall, max(qps) AS qps FROM runs GROUP BY ALL), l AS (SELECT *, lead(recall) OVER w AS r2, lead(qps) OVER w AS q2, row_number() OVER w = 1 AS first FROM b WINDOW w AS (PARTITION BY method ORDER BY recall, qps)),
x AS (SELECT *, recall < target AND r2 >= target AS inside FROM l, (SELECT unnest([0.01, 0.333, 0.905, 1.0, 1.5]::DOUBLE[]) AS target))
SELECT method, target, round(CASE WHEN inside THEN qps + (q2 - qps) * (target - recall) / (r2 - recall) ELSE qps END, 6) AS qps, CASE WHEN inside THEN 'linear' ELSE '{'best_available' if best else 'clamped'}' END AS interp
FROM x WHERE (first AND recall >= target) OR inside OR (r2 IS NULL AND recall < target {last})"""


def _interpolated(spark, d, best):
    b = runs(spark, d).groupBy("method", "recall").agg(F.max("qps").alias("qps"))
    return R.interpolate(b, "recall", "qps", ["method"], [0.01, 0.333, 0.905, 1.0, 1.5], best).withColumn("qps", F.round("qps", 6))


@query(_interpolation(True))
def interpolate_recall(spark, d):
    return _interpolated(spark, d, True)


@query(_interpolation(False))
def interpolate_clamped(spark, d):
    return _interpolated(spark, d, False)


@query(f"WITH {RUNS}, c AS (SELECT method, config_id, avg(recall) AS recall, avg(qps) AS qps FROM runs GROUP BY ALL) SELECT method, config_id, round(recall, 6) AS recall, round(qps, 4) AS qps FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY (recall >= 0.51) DESC, CASE WHEN recall >= 0.51 THEN qps ELSE recall END DESC, config_id DESC) AS r FROM c) WHERE r = 1")
def best_config(spark, d):
    c = runs(spark, d).groupBy("method", "config_id").agg(F.avg("recall").alias("recall"), F.avg("qps").alias("qps"))
    return R.best_config(c, ["method"], 0.51).withColumns({"recall": F.round("recall", 6), "qps": F.round("qps", 4)})


@query("SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY vec_id) <= 100 THEN 'validation' ELSE 'test' END AS part FROM embeddings")
def query_split(spark, d):
    return files.split_queries(embeddings(spark, d).select("vec_id"), "vec_id", 100)


@query("WITH p AS (SELECT DISTINCT user_id, event_id // 3 AS page FROM events), g AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS g FROM p) SELECT user_id, min(page) AS first_page, count(*) AS n_pages FROM g GROUP BY user_id, g")
def page_runs(spark, d):
    return R.runs_of(events(spark, d).withColumn("page", F.floor(F.col("event_id") / 3).cast("bigint")), "user_id", "page")


@query("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, count_if(embedding IS NULL) AS n_null, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings")
def dataset_validate(spark, d):
    return files.validate(embeddings(spark, d).withColumnRenamed("embedding", "vec"))


@query(f"WITH {RUNS}, r AS (SELECT method, config_id, round(avg(recall), 6) AS recall FROM runs GROUP BY ALL), c AS (SELECT CAST(s_suppkey % 7 AS VARCHAR) AS config_id, max(s_suppkey) AS setting FROM supplier GROUP BY 1) SELECT method, config_id, recall, setting FROM r JOIN c USING (config_id)")
def runs_with_config(spark, d):
    r = runs(spark, d).groupBy("method", "config_id").agg(F.round(F.avg("recall"), 6).alias("recall"))
    c = spark.read.parquet(f"{d}/supplier.parquet").groupBy((F.col("s_suppkey") % 7).cast("string").alias("config_id")).agg(F.max("s_suppkey").alias("setting"))
    return R.with_config(r, c, ["config_id"]).select("method", "config_id", "recall", "setting")


@query(f"WITH {TR} SELECT t.query_id, t.vec_id, t.rank, e.label FROM t LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE label < 5) e USING (vec_id)")
def candidates_with_metadata(spark, d):
    known = embeddings(spark, d).filter("label < 5").select("vec_id", "label")
    return R.with_metadata(truth(spark, d).select("query_id", "vec_id", "rank"), known, ["vec_id"]).select("query_id", "vec_id", "rank", "label")


@query("""WITH r AS (SELECT user_id AS query_id, event_id AS pos, event_id // 7 % 5 AS page FROM events), l AS (SELECT *, lag(pos) OVER (PARTITION BY query_id, page ORDER BY pos) AS b FROM r)
SELECT query_id, pos, page, b IS NOT NULL AND (SELECT count(DISTINCT x.page) FROM r x WHERE x.query_id = l.query_id AND x.pos > l.b AND x.pos < l.pos) < 2 AS cached FROM l""")
def page_cache(spark, d):
    r = events(spark, d).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("pos"), F.expr("event_id div 7 % 5").alias("page"))
    return R.page_requests(r, 2)


@query("SELECT event_id, CAST(coalesce(try_cast(regexp_extract(props, '([-+]?[0-9]*\\.?[0-9]+)', 1) AS DOUBLE), 0.0) AS DOUBLE) AS number FROM events")
def parameter_number(spark, d):
    return events(spark, d).select("event_id", R.number_in(F.col("props")).alias("number"))


@query("SELECT event_type, CAST(event_id AS BIGINT) AS id, value FROM events")
def parse_run_log(spark, d):
    lines = events(spark, d).select(F.format_string("run type=%s id=%s, value=%s;", "event_type", "event_id", F.col("value").cast("string")).alias("line"))
    got = files.parse_log(lines, "line", {"type": "string", "id": "bigint", "value": "double"})
    return got.select(F.col("type").alias("event_type"), "id", "value")


@query("SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS requests, count(DISTINCT event_type) AS stages, CAST(count_if(value > 50) AS BIGINT) AS survivors FROM events GROUP BY user_id")
def io_stage_sums(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents"), F.count(F.lit(1)).alias("requests"), F.countDistinct("event_type").alias("stages"), F.count_if(F.col("value") > 50).alias("survivors"))


@query("SELECT count(DISTINCT user_id) AS queries, CAST(sum(event_id) AS BIGINT) AS total_event_id, CAST(sum(k) AS BIGINT) AS total_k, round(sum(event_id) / count(DISTINCT user_id), 6) AS mean_event_id, round(sum(k) / count(DISTINCT user_id), 6) AS mean_k FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def distance_counts(spark, d):
    trace = events(spark, d).select(F.col("user_id").alias("query_id"), "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    s = M.distance_counts(trace, ["event_id", "k"])
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c.startswith("mean_")})


@query(f"WITH {dist_sql()}, t AS ({top_sql()}), r AS (SELECT query_id, dist AS exact, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 1), vec_id) AS rank FROM t) SELECT round(avg(CASE WHEN y.exact <= x.exact THEN 1.0 ELSE 0.0 END), 9) AS flip_rate FROM r x JOIN r y ON x.query_id = y.query_id AND x.rank < y.rank")
def flip_rate_returned(spark, d):
    again = truth(spark, d).withColumnRenamed("dist", "exact").drop("rank").withColumn("dist", F.round("exact", 1))
    return M.flip_rate_returned(S.top_k(again, K)).select(F.round("flip_rate", 9).alias("flip_rate"))


@query(f"WITH {TR} SELECT round(avg(abs(round(dist, 2) - dist)), 9) AS mean_error, round(quantile_disc(abs(round(dist, 2) - dist), 0.95), 9) AS p95_error FROM t")
def absolute_error(spark, d):
    return M.error_summary(_approx(spark, d), M.absolute_error(F.col("approx"), F.col("dist"))).select(F.round("mean_error", 9).alias("mean_error"), F.round("p95_error", 9).alias("p95_error"))


@query(f"WITH {dist_sql(IP)}, t AS ({top_sql()}), n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT round(avg(abs(round(dist, 2) - dist) / (a.n * b.n)), 9) AS mean_error, round(quantile_disc(abs(round(dist, 2) - dist) / (a.n * b.n), 0.95), 9) AS p95_error FROM t JOIN n a ON a.vec_id = query_id JOIN n b ON b.vec_id = t.vec_id")
def ip_error(spark, d):
    t = S.knn(queries(spark, d), base(spark, d), K, "ip", own=False)
    norm = lambda by, name: embeddings(spark, d).select(F.col("vec_id").alias(by), V.l2_norm(F.col("embedding")).alias(name))
    rows = t.join(norm("query_id", "qn"), "query_id").join(norm("vec_id", "n"), "vec_id")
    return M.error_summary(rows, M.ip_error(F.round("dist", 2), F.col("dist"), F.col("qn"), F.col("n"))).select(F.round("mean_error", 9).alias("mean_error"), F.round("p95_error", 9).alias("p95_error"))


@query(f"WITH {dist_sql()}, t AS ({top_sql()}), r AS ({top_sql(20, '(SELECT query_id, vec_id, round(dist, 1) AS dist FROM d)')}), h AS (SELECT t.query_id, count(*) AS h FROM t JOIN r ON r.query_id = t.query_id AND r.vec_id = t.vec_id AND t.rank <= 5 GROUP BY 1) SELECT DISTINCT t.query_id, coalesce(h, 0) / 5.0 AS recall FROM t LEFT JOIN h USING (query_id)")
def recall_of_target(spark, d):
    return M.recall_of_target(rough(spark, d, 20), truth(spark, d), 5, 20)


@query(f"""WITH {dist_sql()}, t AS ({top_sql()}), h AS ({top_sql(20, '(SELECT * FROM d WHERE vec_id % 2 = 0)')}),
u AS (SELECT query_id, vec_id, 0 AS p, rank FROM t UNION ALL SELECT query_id, vec_id, 1, rank FROM h UNION ALL SELECT query_id, vec_id, 2, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) FROM d),
f AS (SELECT query_id, vec_id, p, rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY p, rank) = 1)
SELECT query_id, vec_id, cand_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, rank) AS cand_rank FROM f) WHERE cand_rank <= 25""")
def candidate_construction(spark, d):
    q, b = queries(spark, d), base(spark, d)
    part = lambda df, p: df.select("query_id", "vec_id", F.lit(p).alias("p"), "rank")
    # of the fill, 25 rows and as many more as the other two parts can hold decide, and one for the query itself
    first = b.select("vec_id").orderBy("vec_id").limit(25 + K + 20 + 1)
    fill = S.top_k(q.select("query_id").join(F.broadcast(first)).filter("query_id <> vec_id"), 25 + K + 20, by="vec_id")
    # one scan: the 20 nearest of even and of odd ids hold the ten nearest of all
    near = stage_table(S.best_rows(q, b.select("vec_id", "vec", F.expr("vec_id % 2 = 0").alias("even")), 20, own=False, per="even"), "near")
    u = part(S.top_k(near, K), 0).unionByName(part(S.top_k(near.filter("even"), 20), 1)).unionByName(part(fill, 2))
    kept = R.dedup_first(u, ["query_id", "vec_id"], ["p", "rank"]).withColumn("order", F.col("p") * 1_000_000 + F.col("rank"))
    return S.top_k(kept, 25, by="order", rank="cand_rank").select("query_id", "vec_id", "cand_rank")
