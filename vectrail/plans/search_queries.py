"""Queries of search and multi-vector search: every vector whose id is divisible by 20 is a query, against all vectors but itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import search as S

QUERIES, SQL = {}, {}
STEP, K = 20, 10
IS_QUERY = f"vec_id % {STEP} = 0"


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def queries(spark, d):
    return embeddings(spark, d).filter(IS_QUERY).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def base(spark, d):
    return embeddings(spark, d).select("vec_id", F.col("embedding").alias("vec"), "label")


def all_distances(spark, d, metric="l2_sq"):
    return S.distances(queries(spark, d), base(spark, d), metric, own=False)


def out(df, *more):
    """The usual columns, the distance rounded to six digits."""
    return df.select("query_id", "rank", "vec_id", F.round("dist", 6).alias("dist"), *more)


IP = "list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * b.v[i]))"
L2 = "list_sum(list_transform(generate_series(1, len(q.v)), lambda i: (q.v[i] - b.v[i]) * (q.v[i] - b.v[i])))"
NQ = "sqrt(list_sum(list_transform(q.v, lambda x: x * x)))"
NB = "sqrt(list_sum(list_transform(b.v, lambda x: x * x)))"


def dist_sql(metric: str = L2, where: str = "true") -> str:
    return f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {IS_QUERY}),
b AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE {where}),
d AS (SELECT query_id, vec_id, label, {metric} AS dist FROM q, b WHERE query_id <> vec_id)"""


def top_sql(k: int = K, source: str = "d", by: str = "dist") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {by}, vec_id) AS rank FROM {source} QUALIFY rank <= {k}"


def knn_sql(metric: str = L2, where: str = "true", k: int = K) -> str:
    return f"WITH {dist_sql(metric, where)}, t AS ({top_sql(k)}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t"


for _name, _metric, _sql in (
    ("knn_l2", "l2_sq", L2),
    ("knn_l2_sqrt", "l2", f"sqrt({L2})"),
    ("knn_ip_score", "ip_score", f"-({IP})"),
    ("knn_ip_distance", "ip_distance", f"1 - {IP}"),
    ("knn_cosine", "cosine", f"1 - greatest(-1.0, least(1.0, {IP} / ({NQ} * {NB})))"),
    ("knn_cosine_normalized", "cosine_normalized", f"1 - {IP}"),
):
    QUERIES[_name] = lambda spark, d, m=_metric: out(S.knn(queries(spark, d), base(spark, d), K, m, own=False))
    SQL[_name] = knn_sql(_sql)


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 6) AS l1, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS l2 FROM embeddings")
def vector_norms(spark, d):
    e = embeddings(spark, d)
    return e.select("vec_id", F.round(V.l1_norm(F.col("embedding")), 6).alias("l1"), F.round(V.l2_norm(F.col("embedding")), 6).alias("l2"))


@query(knn_sql())
def knn_arrow(spark, d):
    return out(S.knn_arrow(queries(spark, d), base(spark, d), K, own=False))


INT_L2 = "list_sum(list_transform(generate_series(1, len(q.v)), lambda i: CAST((CAST(round(q.v[i] * 127) AS BIGINT) - CAST(round(b.v[i] * 127) AS BIGINT)) * (CAST(round(q.v[i] * 127) AS BIGINT) - CAST(round(b.v[i] * 127) AS BIGINT)) AS BIGINT)))"


@query(f"WITH {dist_sql(INT_L2)}, t AS ({top_sql()}) SELECT query_id, rank, vec_id, CAST(dist AS BIGINT) AS dist FROM t")
def knn_int_l2(spark, d):
    whole = lambda c: F.transform(V.doubles(c), lambda x: F.round(x * 127).cast("bigint"))
    q, b = queries(spark, d).withColumn("qvec", whole("qvec")), base(spark, d).withColumn("vec", whole("vec"))
    return S.knn(q, b, K, "int_l2_sq", own=False).select("query_id", "rank", "vec_id", "dist")


@query(f"WITH {dist_sql()} SELECT query_id, vec_id, round(dist, 6) AS dist FROM d WHERE dist <= 1.6")
def range_l2(spark, d):
    return S.pairs_within(queries(spark, d), base(spark, d), 1.6, own=False).select("query_id", "vec_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {dist_sql()} SELECT query_id, vec_id, round(dist, 6) AS dist FROM d WHERE dist > 1.4 AND dist <= 1.6")
def range_inner(spark, d):
    return S.within(S.pairs_within(queries(spark, d), base(spark, d), 1.6, own=False), 1.6, 1.4).select("query_id", "vec_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {dist_sql(where='label < 3')} SELECT query_id, vec_id, round(dist, 6) AS dist FROM d WHERE dist <= 1.7")
def range_filtered(spark, d):
    hits = S.pairs_within(queries(spark, d), base(spark, d).filter("label < 3"), 1.7, own=False)
    return hits.select("query_id", "vec_id", F.round("dist", 6).alias("dist"))


@query(knn_sql(where="label = 3"))
def knn_prefilter(spark, d):
    return out(S.knn(queries(spark, d), base(spark, d).filter("label = 3"), K, own=False))


@query(f"WITH {dist_sql()}, t AS ({top_sql(50)}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t WHERE label = 3")
def knn_postfilter(spark, d):
    return out(S.knn(queries(spark, d), base(spark, d), 50, own=False).filter("label = 3"))


@query(f"WITH {dist_sql()}, e AS (SELECT *, CASE WHEN label = 3 THEN dist * 0.8 ELSE dist END AS key FROM d), t AS ({top_sql(source='e', by='key')}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist, round(key, 6) AS key FROM t")
def knn_inline_beta(spark, d):
    return out(S.beta_biased(queries(spark, d), base(spark, d), F.col("label") == 3, 0.8, K, own=False), F.round("key", 6).alias("key"))


@query(f"""WITH {dist_sql()}, i AS (SELECT query_id, vec_id, label, dist, row_number() OVER (PARTITION BY query_id, label ORDER BY dist, vec_id) AS r FROM d QUALIFY r <= 2),
t AS ({top_sql(source='i')}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist, label FROM t""")
def knn_diverse(spark, d):
    return out(S.diverse(queries(spark, d), base(spark, d), K, 2, "label", own=False), "label")


@query(f"WITH {dist_sql()}, t AS ({top_sql(15)}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist, CAST(floor((rank - 1) / 5) AS BIGINT) AS page FROM t")
def knn_paged(spark, d):
    return out(S.paged(S.knn(queries(spark, d), base(spark, d), 15, own=False), 5), "page")


@query(f"WITH {dist_sql(where='true')}, e AS (SELECT * FROM d WHERE dist <= 1.5), t AS ({top_sql(5, 'e')}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t")
def knn_epsilon_stop(spark, d):
    return out(S.epsilon_stop(S.knn(queries(spark, d), base(spark, d), 5, own=False), 1.5))


@query(f"WITH {dist_sql()}, m AS (SELECT query_id, label AS doc, min(dist) AS dist FROM d GROUP BY ALL) SELECT query_id, doc, round(dist, 6) AS dist, row_number() OVER (PARTITION BY query_id ORDER BY m.dist, doc) AS rank FROM m QUALIFY rank <= 3")
def knn_multidoc_stop(spark, d):
    near = S.first_documents(queries(spark, d), base(spark, d).withColumnRenamed("label", "doc"), 3, "doc", own=False)
    return near.select("query_id", "doc", F.round("dist", 6).alias("dist"), "rank")


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {IS_QUERY}), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT query_id, vec_id, {L2} AS dist FROM q, b WHERE query_id <> vec_id), t AS ({top_sql()}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t""")
def knn_by_element(spark, d):
    everything = embeddings(spark, d).select("vec_id", F.col("embedding").alias("vec"))
    return out(S.knn(queries(spark, d), everything, K, own=False))


@query(knn_sql(where="vec_id % 7 <> 0"))
def knn_deleted_mask(spark, d):
    gone = embeddings(spark, d).filter("vec_id % 7 = 0").select("vec_id")
    return out(S.knn(queries(spark, d), S.without(base(spark, d), gone), K, own=False))


@query(f"WITH {dist_sql()}, e AS (SELECT * FROM d WHERE (query_id // {STEP} + label) % 2 = 0), t AS ({top_sql(source='e')}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t")
def ground_truth_bitmap(spark, d):
    """Of each query's own allowed rows; the condition meets the pairs before any distance."""
    allowed = S.pairs(queries(spark, d), base(spark, d), own=False).filter(F.expr(f"(query_id div {STEP} + label) % 2 = 0"))
    return out(S.top_k(allowed.withColumn("dist", V.l2_sq(F.col("qvec"), F.col("vec"))), K))


_SKIP = dist_sql(where="vec_id >= 5")


@query(f"WITH {_SKIP}, t AS ({top_sql()}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t UNION ALL SELECT query_id, 10 + n, -n, NULL FROM (SELECT DISTINCT query_id FROM d), (SELECT unnest([1, 2]) AS n)")
def ground_truth_skip_tail(spark, d):
    """Ground truth that skips the first five rows and ends in two rows of ids to come."""
    return out(M.with_tail(S.knn(queries(spark, d), base(spark, d).filter("vec_id >= 5"), K, own=False), K, [-1, -2]))


@query("""WITH c AS (SELECT label, count_if(vec_id % 3 = 0 AND label % 3 <> 0) AS m, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT 100, count_if(vec_id % 30 = 0), count(*) FROM embeddings UNION ALL SELECT 101, count_if(vec_id % 2 = 0), count(*) FROM embeddings)
SELECT label, CAST(floor(100 * greatest(1.0, least(CASE WHEN m = 0 THEN 10.0 WHEN m / n >= 0.5 THEN 1.0 WHEN m / n >= 0.1 THEN 2.0 ELSE pow(2.0, -log10(m / n)) END, 10.0))) AS BIGINT) AS l_size FROM c""")
def adaptive_l(spark, d):
    e = embeddings(spark, d)
    count = lambda df, by: df.groupBy("label").agg(F.count_if(by).alias("m"), F.count(F.lit(1)).alias("n"))
    c = count(e, F.expr("vec_id % 3 = 0 and label % 3 <> 0"))
    for label, step in ((100, 30), (101, 2)):
        c = c.unionByName(count(e.withColumn("label", F.lit(label)), F.col("vec_id") % step == 0))
    return c.select("label", S.adaptive_l(100, F.col("m"), F.col("n"), 10.0).alias("l_size"))


_HOPS = f"""g AS (SELECT query_id AS src, vec_id AS dst FROM ad QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= 8),
p AS (SELECT query_id, vec_id, label, dist FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= 8),
h AS (SELECT DISTINCT query_id, dst AS vec_id FROM p JOIN g ON g.src = p.vec_id WHERE p.label NOT IN (1, 4, 7) AND dst <> query_id),
c AS (SELECT query_id, vec_id FROM p UNION SELECT query_id, vec_id FROM h), r AS (SELECT c.query_id, c.vec_id, dist FROM c JOIN d USING (query_id, vec_id) WHERE label IN (1, 4, 7))"""
_ALL = f"aq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings), ad AS (SELECT query_id, vec_id, {L2} AS dist FROM aq AS q, aq2 AS b WHERE query_id <> vec_id)"


@query(f"WITH {dist_sql()}, aq2 AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), {_ALL}, {_HOPS}, t AS ({top_sql(source='r')}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t")
def two_hop_filtered(spark, d):
    """From a query's eight nearest, those that fail the filter are passed through to their own eight neighbours; what passes is ranked."""
    e = base(spark, d)
    edges = S.knn_arrow(e.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), e, 8, own=False).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"))
    first = S.knn_arrow(queries(spark, d), e, 8, own=False).select("query_id", "vec_id").join(e.select("vec_id", "label"), "vec_id")
    passes = F.col("label").isin(1, 4, 7)
    through = first.filter(~passes).join(edges, F.col("vec_id") == F.col("src")).filter("dst <> query_id").select("query_id", F.col("dst").alias("vec_id"))
    reached = first.select("query_id", "vec_id").unionByName(through).distinct().join(e.filter(passes), "vec_id").join(queries(spark, d), "query_id")
    return out(S.top_k(reached.withColumn("dist", V.l2_sq(F.col("qvec"), F.col("vec"))), K))


_FIRST = f"f AS (SELECT query_id, max(dist) <= 1.5 AS more FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) <= 4) GROUP BY 1)"


@query(f"WITH {dist_sql()}, {_FIRST}, t AS (SELECT d.*, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS n FROM d), s AS (SELECT query_id, vec_id, dist FROM t JOIN f USING (query_id) WHERE (n <= 4 OR (more AND dist <= 1.8)) AND dist > 0.8 AND dist <= 1.5), r AS ({top_sql(20, 's')}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM r")
def range_two_phase(spark, d):
    return out(S.range_two_phase(all_distances(spark, d), 1.5, 4, 1.2, 0.8, 20))


# multi-vector: vectors of one label and id modulo 8 are the tokens of a document; three query vectors in a row are the tokens of a query
TOKENS = f"""q AS (SELECT vec_id // {3 * STEP} AS query_id, vec_id AS qtok, embedding::DOUBLE[] AS v FROM embeddings WHERE {IS_QUERY}),
b AS (SELECT label * 8 + vec_id % 8 AS doc, vec_id AS dtok, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT query_id, qtok, doc, dtok, -({IP}) AS dist FROM q, b WHERE qtok <> dtok), m AS (SELECT query_id, doc, qtok, min(dist) AS m FROM d GROUP BY ALL)"""


def token_distances(spark, d):
    q = embeddings(spark, d).filter(IS_QUERY).select(F.expr(f"vec_id div {3 * STEP}").alias("query_id"), F.col("vec_id").alias("qtok"), F.col("embedding").alias("qvec"))
    b = base(spark, d).select((F.col("label") * 8 + F.col("vec_id") % 8).alias("doc"), F.col("vec_id").alias("dtok"), "vec")
    return S.pairs(q, b).filter("qtok <> dtok").withColumn("dist", V.ip_score(F.col("qvec"), F.col("vec"))).drop("qvec", "vec")


@query(f"WITH {TOKENS} SELECT query_id, doc, qtok, round(m, 6) AS maxsim FROM m")
def maxsim(spark, d):
    return token_distances(spark, d).groupBy("query_id", "doc", "qtok").agg(F.round(F.min("dist"), 6).alias("maxsim"))


for _name, _how, _sql in (
    ("chamfer", "chamfer", "sum(m) AS value FROM m"),
    ("multivec_avg_pairwise", "average_pairwise", "avg(dist) AS value FROM d"),
    ("multivec_min_pairwise", "min_pairwise", "min(dist) AS value FROM d"),
    ("multivec_avg_of_mins", "average_of_mins", "avg(m) AS value FROM m"),
):
    QUERIES[_name] = lambda spark, d, how=_how: S.multi_vector(token_distances(spark, d), how).select("query_id", "doc", F.round("value", 6).alias("value"))
    SQL[_name] = f"WITH {TOKENS}, r AS (SELECT query_id, doc, {_sql} GROUP BY ALL) SELECT query_id, doc, round(value, 6) AS value FROM r"
