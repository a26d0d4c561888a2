"""Queries of quantizers, two-stage search, graphs and mutation logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import metrics as M
from ..operators import search as S
from ..quant import closed_form as C
from ..quant import product as P
from ..quant import rotated as X
from ..quant import spherical as H
from ..sources import vectors as files
from ..streaming import log as L
from .search_queries import IP, IS_QUERY, K, L2, NB, NQ, base, dist_sql, embeddings, out, queries, top_sql

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark, d):
    return embeddings(spark, d).select("vec_id", F.col("embedding").alias("vec"), "label")


def codes_text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


V_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
_JOIN = "list_aggregate(list_transform({}, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')"


@query(f"WITH {V_SQL} SELECT vec_id, {_JOIN.format('list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)')} AS codes FROM v")
def binary_codes(spark, d):
    return vectors(spark, d).select("vec_id", codes_text(C.binary_codes(F.col("vec"))).alias("codes"))


_HAM = "CAST(list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN (q.v[i] > 0) <> (b.v[i] > 0) THEN 1 ELSE 0 END)) AS BIGINT)"


@query(f"WITH {dist_sql(_HAM)}, t AS ({top_sql()}) SELECT query_id, rank, vec_id, dist, 64 - 2 * dist AS sign_dot FROM t")
def hamming_knn(spark, d):
    q = queries(spark, d).withColumn("qvec", B.sign_words(F.col("qvec"), 64))
    b = base(spark, d).withColumn("vec", B.sign_words(F.col("vec"), 64))
    near = S.top_k(S.pairs(q, b, own=False).withColumn("dist", V.hamming(F.col("qvec"), F.col("vec"))).withColumn("sign_dot", V.sign_dot(F.col("qvec"), F.col("vec"), 64)), K)
    return near.select("query_id", "rank", "vec_id", "dist", "sign_dot")


def mm_sql(bits: int) -> str:
    top = 2**bits - 1
    return f"""{V_SQL}, r AS (SELECT vec_id, v, (list_max(v) + list_min(v)) / 2 - (list_max(v) - list_min(v)) / 2 * 1.0 AS low, 2 * ((list_max(v) - list_min(v)) / 2 * 1.0) / {top} AS step FROM v),
m AS (SELECT vec_id, low, step, list_transform(v, lambda x: CAST(CASE WHEN step = 0 THEN 0 ELSE round(greatest(0.0, least({float(top)}, (x - low) / step))) END AS BIGINT)) AS codes FROM r)"""


for _bits in (1, 4, 8):
    QUERIES[f"minmax_{_bits}bit"] = lambda spark, d, b=_bits: vectors(spark, d).select("vec_id", C.minmax(F.col("vec"), b).alias("q")).select("vec_id", codes_text(F.col("q.codes")).alias("codes"))
    SQL[f"minmax_{_bits}bit"] = f"WITH {mm_sql(_bits)} SELECT vec_id, {_JOIN.format('codes')} AS codes FROM m"

_MM = f"{mm_sql(4)}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {IS_QUERY}), b AS (SELECT vec_id, list_transform(codes, lambda c: low + step * c) AS v FROM m), d AS (SELECT query_id, vec_id, {L2} AS dist FROM q, b WHERE query_id <> vec_id)"


def minmax_nearest(spark, d, k, bits=4):
    b = base(spark, d).withColumn("q", C.minmax(F.col("vec"), bits)).withColumn("vec", C.decode(F.col("q"))).drop("q")
    return S.knn(queries(spark, d), b, k, own=False)


@query(f"WITH {_MM}, t AS ({top_sql()}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t")
def minmax_knn(spark, d):
    return out(minmax_nearest(spark, d, K))


@query(f"""WITH {_MM}, c AS ({top_sql(30)}), e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT c.query_id, c.vec_id, list_sum(list_transform(generate_series(1, 64), lambda i: (q.v[i] - e.v[i]) * (q.v[i] - e.v[i]))) AS dist FROM c JOIN q USING (query_id) JOIN e ON e.vec_id = c.vec_id), t AS ({top_sql(source='x')})
SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t""")
def coarse_rerank_knn(spark, d):
    return out(S.coarse_rerank(minmax_nearest(spark, d, 30), queries(spark, d), base(spark, d), 30, K))


_EXACT = f"xb AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), xd AS (SELECT query_id, vec_id, {L2} AS dist FROM q, xb AS b WHERE query_id <> vec_id)"


@query(f"WITH {_MM}, c AS ({top_sql(30)}), {_EXACT}, t AS ({top_sql(source='xd')}) SELECT count(*) AS hits, count(*) / (10.0 * (SELECT count(DISTINCT query_id) FROM t)) AS recall FROM c JOIN t USING (query_id, vec_id)")
def coarse_rerank_recall(spark, d):
    return M.recall(S.coarse_rerank(minmax_nearest(spark, d, 30), queries(spark, d), base(spark, d), 30, K), S.knn(queries(spark, d), base(spark, d), K, own=False), K)


_SQ = "x AS (SELECT unnest(generate_series(0, 63)) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings), s AS (SELECT dim, avg(x) AS m, var_pop(x) AS s2 FROM x GROUP BY dim), p AS (SELECT sqrt(max(s2)) * 2.0 AS p FROM s)"


@query(f"WITH {_SQ} SELECT CAST(dim AS BIGINT) AS dim, round(m - p, 6) AS shift, round(2 * p, 6) AS scale FROM s, p")
def sq_train(spark, d):
    return C.scalar_model(vectors(spark, d)).select("dim", F.round("shift", 6).alias("shift"), F.round("scale", 6).alias("scale"))


_SQC = f"{_SQ}, {V_SQL}, sh AS (SELECT list(m - p ORDER BY dim) AS sh, max(2 * p) AS scale FROM s, p), c AS (SELECT vec_id, sh, scale, list_transform(generate_series(1, 64), lambda i: CAST(round(greatest(0.0, least(15.0, (v[i] - sh[i]) / scale * 15))) AS BIGINT)) AS codes FROM v, sh)"


@query(f"WITH {_SQC} SELECT vec_id, {_JOIN.format('codes')} AS codes FROM c")
def sq_codes(spark, d):
    sq = C.ScalarQuantizer.train(vectors(spark, d), 4)
    return vectors(spark, d).select("vec_id", codes_text(sq.codes(F.col("vec"))).alias("codes"))


@query(f"WITH {_SQC}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {IS_QUERY}), b AS (SELECT vec_id, list_transform(generate_series(1, 64), lambda i: sh[i] + codes[i] * scale / 15) AS v FROM c), d AS (SELECT query_id, vec_id, {L2} AS dist FROM q, b WHERE query_id <> vec_id), t AS ({top_sql()}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t")
def sq_knn(spark, d):
    sq = C.ScalarQuantizer.train(vectors(spark, d), 4)
    b = base(spark, d).withColumn("vec", sq.decode(sq.codes(F.col("vec"))))
    return out(S.knn(queries(spark, d), b, K, own=False))


def codec_sql(bits: int) -> str:
    if bits == 1:
        scale, code = "list_sum(list_transform(v, lambda x: abs(x))) / len(v)", "CASE WHEN x > 0 THEN 1 ELSE -1 END"
    else:
        scale, code = f"list_max(list_transform(v, lambda x: abs(x))) / {float(2 ** (bits - 1) - 1)}", "CAST(round_even(x / scale, 0) AS BIGINT)"
    return f"""WITH qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, {scale.replace('(v', '(embedding::DOUBLE[]')} AS scale FROM embeddings WHERE {IS_QUERY}),
q AS (SELECT query_id, scale, list_transform(v, lambda x: {code}) AS v FROM qs), b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE -1 END) AS v FROM embeddings),
d AS (SELECT query_id, vec_id, -(scale * CAST(list_sum(list_transform(generate_series(1, 64), lambda i: q.v[i] * b.v[i])) AS BIGINT)) AS dist FROM q, b WHERE query_id <> vec_id), t AS ({top_sql()}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t"""


def codec_scan(spark, d, bits):
    q = queries(spark, d).withColumn("qvec", C.query_codec(F.col("qvec"), bits))
    signs = F.transform("vec", lambda x: F.when(x > 0, 1).otherwise(-1).cast("bigint"))
    return out(S.top_k(S.pairs(q, base(spark, d).withColumn("vec", signs), own=False).withColumn("dist", -C.signs_dot(F.col("qvec"), F.col("vec"))), K))


for _name, _bits in (("b1_query_scan", 1), ("int4_query_scan", 4), ("int8_query_scan", 8)):
    QUERIES[_name] = lambda spark, d, b=_bits: codec_scan(spark, d, b)
    SQL[_name] = codec_sql(_bits)

_SIGNED = "list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN b.v[i] > 0 THEN q.v[i] ELSE -q.v[i] END))"


@query(f"WITH {dist_sql('-(' + _SIGNED + ')')}, t AS ({top_sql()}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t")
def full_query_scan(spark, d):
    signs = F.transform("vec", lambda x: F.when(x > 0, 1.0).otherwise(-1.0))
    return out(S.knn(queries(spark, d), base(spark, d).withColumn("vec", signs), K, "ip_score", own=False))


@query(f"WITH {mm_sql(4)} SELECT vec_id, list_aggregate(list_transform(generate_series(1, 63, 2), lambda i: lpad(printf('%X', codes[i] + 16 * codes[i + 1]), 2, '0')), 'string_agg', '') AS packed FROM m")
def nibble_pack(spark, d):
    return vectors(spark, d).select("vec_id", B.nibbles(C.minmax(F.col("vec"), 4)["codes"]).alias("packed"))


@query(f"""WITH {V_SQL}, p AS (SELECT vec_id, list_transform(generate_series(1, 63, 2), lambda i: {{'x': v[i], 'y': v[i + 1]}}) AS p FROM v), t AS (SELECT vec_id, p, list_max(list_transform(p, lambda z: sqrt(z.x * z.x + z.y * z.y))) AS top FROM p)
SELECT vec_id, {_JOIN.format("list_transform(p, lambda z: ((CAST(round(atan2(z.y, z.x) / 6.283185307179586 * 16) AS BIGINT) % 16 + 16) % 16) * 16 + CAST(round(sqrt(z.x * z.x + z.y * z.y) / top * 15) AS BIGINT))")} AS codes FROM t""")
def polar_block_codes(spark, d):
    return vectors(spark, d).select("vec_id", codes_text(C.polar_blocks(F.col("vec"))).alias("codes"))


@query("""WITH c AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 8), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT unnest(generate_series(0, 7)) AS centre),
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 8), d AS (SELECT vec_id, query_id, """ + L2 + """ AS dist FROM q, b), a AS (SELECT vec_id, query_id AS centre FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, query_id) = 1)
SELECT centre, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS mean FROM (SELECT centre, unnest(generate_series(0, 63)) AS dim, unnest(v) AS x FROM a JOIN b USING (vec_id)) GROUP BY ALL""")
def kmeans_step(spark, d):
    """One assignment and update: centres are the first eight vectors."""
    e = vectors(spark, d)
    c = e.filter("vec_id < 8").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    near = S.distances(c, e.select("vec_id", "vec")).groupBy("vec_id").agg(F.min_by("query_id", F.struct("dist", "query_id")).alias("centre"))
    return near.join(e, "vec_id").select("centre", F.posexplode(V.doubles("vec")).alias("dim", "x")).groupBy("centre", F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query(f"WITH {mm_sql(4)}, b AS (SELECT vec_id, list_transform(generate_series(0, 191), lambda i: ((codes[i // 3 + 1] // 2) >> (i % 3)) & 1) AS b FROM m) SELECT vec_id, {_JOIN.format('list_transform(generate_series(0, 23), lambda k: list_sum(list_transform(generate_series(1, 8), lambda i: b[k * 8 + i] << (i - 1))))')} AS packed FROM b")
def three_bit_pack(spark, d):
    codes = F.transform(C.minmax(F.col("vec"), 4)["codes"], lambda c: F.floor(c / 2).cast("bigint"))
    return vectors(spark, d).select("vec_id", codes_text(B.pack(codes, 3)).alias("packed"))


@query(f"WITH {mm_sql(8)} SELECT vec_id, {_JOIN.format('list_transform(codes, lambda c: CAST(round(c * 15 / 255) AS BIGINT))')} AS codes FROM m")
def minmax_recompress(spark, d):
    return vectors(spark, d).select("vec_id", codes_text(C.recompress(C.minmax(F.col("vec"), 8), 8, 4)["codes"]).alias("codes"))


_DEC = "list_transform(generate_series(1, 64), lambda i: sh[i] + codes[i] * scale / 15)"
_CODED = f"WITH {_SQC}, q AS (SELECT vec_id AS query_id, {_DEC} AS v FROM c WHERE {IS_QUERY}), b AS (SELECT vec_id, {_DEC} AS v FROM c)"
for _name, _f, _sql in (
    ("sq_codes_l2_knn", "l2_sq", L2),
    ("sq_codes_ip_knn", "ip", f"-({IP})"),
    ("sq_codes_cosine_knn", "cosine", f"1 - greatest(-1.0, least(1.0, {IP} / ({NQ} * {NB})))"),
):
    SQL[_name] = f"{_CODED}, d AS (SELECT query_id, vec_id, {_sql} AS dist FROM q, b WHERE query_id <> vec_id), r AS (SELECT query_id, vec_id, round(dist, 9) AS dist FROM d), t AS ({top_sql(source='r')}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t"

    def _coded(spark, d, f=_f):
        sq = C.ScalarQuantizer.train(vectors(spark, d), 4)
        c = vectors(spark, d).select("vec_id", sq.codes(F.col("vec")).alias("vec"))
        q = c.filter(IS_QUERY).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
        measure = getattr(sq, f)
        dist = measure(F.col("qvec"), F.col("vec"))
        return out(S.top_k(S.pairs(q, c, own=False).withColumn("dist", F.round(-dist if f == "ip" else dist, 9)), K))

    QUERIES[_name] = _coded


@query("SELECT CAST(dim AS BIGINT) AS dim, round(quantile_cont(x, 0.01), 6) AS shift, round(quantile_cont(x, 0.99) - quantile_cont(x, 0.01), 6) AS scale FROM (SELECT unnest(generate_series(0, 63)) AS dim, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY dim")
def sq_percentile_train(spark, d):
    return C.percentile_model(vectors(spark, d)).select("dim", F.round("shift", 6).alias("shift"), F.round("scale", 6).alias("scale"))


@query("SELECT vec_id, list_contains(list_transform(embedding, lambda x: x > 0.3), true) AS has_large, list_contains([3, 5], label) AS chosen FROM embeddings")
def contains_value(spark, d):
    return vectors(spark, d).select("vec_id", V.contains(F.transform("vec", lambda x: x > 0.3), True).alias("has_large"), V.contains(F.array(F.lit(3), F.lit(5)), F.col("label")).alias("chosen"))


for _b in (1, 2, 4, 8):

    def _spherical(spark, d, b=_b):
        q = H.QUANTIZERS[f"spherical_{b}"]().fit(base(spark, d))
        return out(q.search(q.encode(base(spark, d)), queries(spark, d), K, own=False))

    QUERIES[f"spherical_{_b}bit_knn"] = _spherical


@query()
def rerank_sweep(spark, d):
    """Recall of exact rerank by the number of 1-bit candidates."""
    q = H.Spherical(1).fit(base(spark, d))
    coarse = q.search(q.encode(base(spark, d)), queries(spark, d), 100, own=False).drop("rank")
    return H.sweep(coarse, queries(spark, d), base(spark, d), S.knn_arrow(queries(spark, d), base(spark, d), K, own=False), K, [10, 20, 50, 100])


# ---- rotated codes, product quantization and inverted lists: approximate, checked in tests

def mean_vector(spark, d) -> list[float]:
    return list(M.centroid(vectors(spark, d)).first()["qvec"])


def rotated(spark, d, bits=8):
    c = mean_vector(spark, d)
    return X.encode_table(base(spark, d), c, bits=bits), c


@query()
def rotated_codes(spark, d):
    return X.encode_table(vectors(spark, d), mean_vector(spark, d))


@query()
def rotated_knn(spark, d):
    codes, c = rotated(spark, d, 0)
    return out(X.search(codes, queries(spark, d), c, K, own=False))


@query()
def rotated_gate(spark, d):
    codes, c = rotated(spark, d, 0)
    return out(X.search(codes, queries(spark, d), c, K, gated=True, own=False))


@query()
def residual_rerank(spark, d):
    """The 30 nearest by codes get distances from codes and residuals; the 10 nearest of these are returned."""
    codes, c = rotated(spark, d)
    near = X.search(codes, queries(spark, d), c, 30, own=False).select("query_id", "vec_id")
    return out(S.top_k(X.rescore(near, codes, queries(spark, d), c), K))


@query()
def sign_interval(spark, d):
    """Estimate and bounds from signs of the 30 nearest by signs."""
    codes, c = rotated(spark, d, 0)
    s = X.search(codes, queries(spark, d), c, 30, by="short", own=False).select("query_id", "vec_id")
    s = X.rescore(s, codes, queries(spark, d), c)
    return s.select("query_id", "vec_id", F.round("short", 6).alias("estimate"), F.round("short_low", 6).alias("low"), F.round("short_high", 6).alias("high"))


@query()
def pq_codes(spark, d):
    return P.ProductQuantizer.train(vectors(spark, d), 16, 16).encode(vectors(spark, d))


@query()
def pq_adc_knn(spark, d):
    pq = P.ProductQuantizer.train(base(spark, d), 32, 256)
    return out(pq.search(pq.encode(base(spark, d)), queries(spark, d), K, own=False))


@query()
def ivf_knn(spark, d):
    centres = P.kmeans(P.sample_matrix(base(spark, d)), 16)
    probes = P.probe_lists(queries(spark, d), centres, 12)
    rows = P.lists_of(base(spark, d).select("vec_id", "vec"), centres).join(probes, "list").filter("query_id <> vec_id")
    return out(S.top_k(rows.withColumn("dist", V.l2_sq(F.col("qvec"), F.col("vec"))), K))


# ---- graphs

GRAPH = f"""g AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_sum(list_transform(generate_series(1, 64), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
e AS (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS pos FROM g QUALIFY pos < 5)"""


def graph(spark, d):
    """The exact graph of all vectors."""
    return G.knn_graph(vectors(spark, d), 5)


@query(f"WITH {GRAPH} SELECT src, pos, dst, round(dist, 6) AS dist FROM e")
def knn_graph(spark, d):
    return graph(spark, d).withColumn("dist", F.round("dist", 6))


@query(f"WITH {GRAPH}, c AS (SELECT src, count(*) AS d FROM e GROUP BY src) SELECT max(d) AS max_degree, avg(d) AS mean_degree, CAST(sum(d) AS BIGINT) AS edges FROM c")
def degree_stats(spark, d):
    return G.degree_stats(graph(spark, d))


@query(f"WITH {GRAPH} SELECT DISTINCT dst AS node FROM e WHERE src IN (0, 1, 2) AND dst NOT IN (0, 1, 2)")
def one_hop_expand(spark, d):
    front = vectors(spark, d).filter("vec_id < 3").select(F.col("vec_id").alias("node"))
    return G.one_hop(front, graph(spark, d), front)


@query(f"WITH RECURSIVE {GRAPH}, r AS (SELECT CAST(0 AS BIGINT) AS node UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r")
def reachable_nodes(spark, d):
    start = vectors(spark, d).filter("vec_id = 0").select(F.col("vec_id").alias("node"))
    return G.reachable(start, graph(spark, d).select("src", "dst"))


@query()
def robust_prune(spark, d):
    e = vectors(spark, d)
    return G.pruned(e, graph(spark, d).select("src", "dst"), 3, 1.2)


@query()
def neighbour_heuristic(spark, d):
    return G.pruned(vectors(spark, d), graph(spark, d).select("src", "dst"), 5, 1.0)


def parts(spark, d):
    """All vectors in parts of a bounded size."""
    b = base(spark, d)
    n = max(4, -(-b.count() // 50_000))
    return b.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))


@query()
def graph_beam_search(spark, d):
    b = parts(spark, d)
    return out(G.search(b, G.build(b, "part"), "part", queries(spark, d), K, 64, own=False))


@query()
def graph_gated_search(spark, d):
    """Beam search that expands no neighbour whose lower bound from signs is beyond the pool's worst, and stops when four hops in a row bring nothing nearer."""
    b = parts(spark, d)
    return out(G.search(b, G.build(b, "part"), "part", queries(spark, d), K, 64, own=False, gate=True, patience=24))


@query()
def graph_after_changes(spark, d):
    """A graph of two thirds of the vectors, the rest inserted, every seventh deleted with its edges repaired, then searched."""
    b = parts(spark, d)
    first = G.build(b.filter("vec_id % 3 <> 0"), "part")
    grown = G.insert(b, first, "part")
    alive = b.filter("vec_id % 7 <> 0 or vec_id % 20 = 0")
    return out(G.search(alive, G.delete(b, grown, "part", alive.select("vec_id")), "part", queries(spark, d), K, 64, own=False))


@query(f"WITH RECURSIVE {GRAPH}, r AS (SELECT CAST(0 AS BIGINT) AS node, 0 AS hop UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.node WHERE r.hop < 6), m AS (SELECT node, min(hop) AS hop FROM r GROUP BY node) SELECT node, CAST(hop AS BIGINT) AS hop, row_number() OVER (ORDER BY hop, node) - 1 AS place FROM m WHERE hop <= 6")
def bfs_order(spark, d):
    start = vectors(spark, d).filter("vec_id = 0").select(F.col("vec_id").alias("node"))
    return G.bfs_order(start, graph(spark, d).select("src", "dst"), 6)


@query(f"WITH {GRAPH}, c AS (SELECT src AS node, count(*) AS n, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY pos) AS ids FROM e GROUP BY src) SELECT node, sha256(ids) AS checksum FROM c")
def adjacency_checksums(spark, d):
    return files.adjacency_checksum(graph(spark, d)).withColumnRenamed("src", "node")


@query()
def determinant_diversity(spark, d):
    near = S.knn(queries(spark, d), base(spark, d), 20, own=False).join(vectors(spark, d).select("vec_id", "vec"), "vec_id")
    return G.determinant_diverse(near, 5)


# ---- mutation logs: a vector is inserted at stage id % 4, every third replaced at 4, every fifth deleted at 5

def mutations(spark, d):
    e = embeddings(spark, d).select(F.col("vec_id").alias("id"))
    event = lambda df, stage, op, offset: df.select(stage.cast("int").alias("stage"), F.lit(op).alias("op"), "id", offset.alias("offset"))
    i = F.col("id")
    return event(e, i % 4, "insert", i).unionByName(event(e.filter("id % 3 = 0"), F.lit(4), "replace", i + 1)).unionByName(event(e.filter("id % 5 = 0"), F.lit(5), "delete", i)).unionByName(event(e.filter("id % 50 = 0"), F.lit(3), "search", i))


LOG = "log AS (SELECT CAST(vec_id % 4 AS INTEGER) AS stage, 'insert' AS op, vec_id AS id, vec_id AS o FROM embeddings UNION ALL SELECT 4, 'replace', vec_id, vec_id + 1 FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT 5, 'delete', vec_id, vec_id FROM embeddings WHERE vec_id % 5 = 0)"


def active_sql(stage: int) -> str:
    return f"a AS (SELECT id, arg_max(op, stage) AS op, arg_max(o, stage) AS o FROM log WHERE stage <= {stage} GROUP BY id)"


@query(f"WITH {LOG}, {active_sql(5)} SELECT id, o AS \"offset\" FROM a WHERE op <> 'delete'")
def asof_active_set(spark, d):
    return L.active_at(mutations(spark, d), 5)


@query(f"WITH {LOG}, {active_sql(4)}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE {IS_QUERY}), b AS (SELECT a.id AS vec_id, e.embedding::DOUBLE[] AS v FROM a JOIN embeddings e ON e.vec_id = a.o WHERE a.op <> 'delete'), d AS (SELECT query_id, vec_id, {L2} AS dist FROM q, b WHERE query_id <> vec_id), t AS ({top_sql()}) SELECT query_id, rank, vec_id, round(dist, 6) AS dist FROM t")
def streaming_ground_truth(spark, d):
    alive = L.active_at(mutations(spark, d), 4)
    b = alive.join(vectors(spark, d).select(F.col("vec_id").alias("offset"), "vec"), "offset").select(F.col("id").alias("vec_id"), "vec")
    return out(S.knn(queries(spark, d), b, K, own=False))


@query("SELECT CAST(4 AS INTEGER) AS stage, 'delete' AS op, vec_id AS id, 'delete of an absent id' AS error FROM embeddings WHERE vec_id % 35 = 0 UNION ALL SELECT 1, 'insert', vec_id, 'insert of a present id' FROM embeddings WHERE vec_id % 35 = 1")
def runbook_validate(spark, d):
    e = embeddings(spark, d).select(F.col("vec_id").alias("id"))
    row = lambda df, stage, op: df.select(F.lit(stage).alias("stage"), F.lit(op).alias("op"), "id", F.col("id").alias("offset"))
    bad = row(e, 0, "insert").unionByName(row(e.filter("id % 35 = 0"), 2, "delete")).unionByName(row(e.filter("id % 35 = 0"), 4, "delete")).unionByName(row(e.filter("id % 35 = 1"), 1, "insert"))
    return L.validate(bad)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_last_write(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type")
    return L.last_write(e, "user_id", ["event_id"])


@query("WITH q AS (SELECT 5 AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 5), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id <> 5 AND vec_id % 9 <> 0), d AS (SELECT query_id, vec_id, " + L2 + " AS dist FROM q, b) SELECT vec_id, rank, round(dist, 6) AS dist FROM (" + top_sql(5) + ")")
def vector_set_by_element(spark, d):
    s = L.VectorSet(vectors(spark, d), "l2_sq").remove(embeddings(spark, d).filter("vec_id % 9 = 0").select("vec_id"))
    return s.search_by_element(5, 5).select("vec_id", "rank", F.round("dist", 6).alias("dist"))
