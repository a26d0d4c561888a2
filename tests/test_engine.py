"""Queries against DuckDB, and properties that SQL can't state."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vectrail.functions import bits as B
from vectrail.functions import vectors as V
from vectrail.operators import filters as J
from vectrail.operators import graph as G
from vectrail.operators import nearest as N
from vectrail.operators import reports as R
from vectrail.operators import search as S
from vectrail.plans import catalog
from vectrail.plans import quant_queries as QQ
from vectrail.quant import closed_form as C
from vectrail.quant import rotated as X
from vectrail.quant import spherical as H
from vectrail.sources import vectors as files
from vectrail.streaming import log as L

DATA = "/root/testdata/sf0.001"
SOME = ["knn_l2", "knn_cosine", "range_inner", "knn_postfilter", "knn_diverse", "chamfer", "filter_and_or_not", "posting_and", "recall_ties", "recall_filtered",
        "pareto_frontier", "interpolate_recall", "page_runs", "minmax_4bit", "sq_knn", "int4_query_scan", "knn_graph", "asof_active_set", "runbook_validate"]


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "documents", "labels", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*names).collect()) == want


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def rows(spark, x, name="vec_id", column="vec"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, {column} array<float>")


def test_metrics_of_zero_and_nan(spark):
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert z.select(V.cosine_distance(F.col("a"), F.col("b"))).first()[0] == 1.0
    base = rows(spark, [[1.0], [float("nan")]])
    q = rows(spark, [[0.0]], "query_id", "qvec")
    assert [r["vec_id"] for r in S.knn(q, base, 5).collect()] == [0]


def test_blocks_give_what_a_broadcast_gives(spark):
    rng = np.random.default_rng(0)
    q, b = rows(spark, rng.random((7, 4)), "query_id", "qvec"), rows(spark, rng.random((30, 4)))
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id").collect()))
    assert key(S.knn(q, b, 3)) == key(S.knn(q, b, 3, limit=2)) == key(S.knn_arrow(q, b, 3))


LARGE = "absolute_error average_precision candidate_construction candidates_with_metadata coarse_rerank_knn coarse_rerank_recall determinant_diversity flip_rate_pairs flip_rate_ranks flip_rate_returned ground_truth_skip_tail ip_error knn_by_element knn_cosine_normalized knn_deleted_mask knn_inline_beta knn_int_l2 knn_ip_distance knn_ip_score knn_l2 knn_l2_sqrt knn_multidoc_stop knn_postfilter minmax_knn".split()


@pytest.mark.parametrize("name", LARGE)
def test_searches_of_whole_tables_make_no_table_of_all_pairs(spark, monkeypatch, name):
    def refuse(*args, **more):
        raise AssertionError("all pairs")

    monkeypatch.setattr(S, "pairs", refuse)
    assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count()


def odd_vectors(spark, n=300, dim=5):
    """Copies, near ties, zeros, huge, infinite, NaN and broken vectors; labels from a few values and null."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[40:120] = x[40]
    x[130:140] = np.nextafter(x[130], np.float32(9))
    x[150], x[151], x[152], x[153] = 0, 3e38, np.inf, np.nan
    v = [[float(c) for c in r] for r in x]
    v[160], v[161], v[162], v[163] = None, [1.0, None, 0.0, 0.0, 0.0], [], [0.5] * (dim + 1)
    return spark.createDataFrame([(i * 7 % n, v[i], None if i % 11 == 0 else i % 4) for i in range(n)], "vec_id bigint, vec array<float>, label int")


def plain_rank(df, k, *order, keys=("query_id",)):
    w = Window.partitionBy(*keys).orderBy(*order, "vec_id")
    return {tuple(r) for r in df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("dist").cast("string")).collect()}


@pytest.mark.parametrize("metric", sorted(set(N.MEASURES) - {"int_l2_sq"}))
@pytest.mark.parametrize("own", [True, False])
def test_nearest_is_a_full_scan(spark, monkeypatch, metric, own):
    monkeypatch.setattr(N, "QUERIES", 7)
    monkeypatch.setattr(N, "ROWS", 64)
    b = odd_vectors(spark)
    q = b.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    whole = lambda c: f"size({c}) = 5 and not exists({c}, x -> x is null)"
    d = S.distances(q.filter(whole("qvec")), b.filter(whole("vec")), metric, own=own).cache()
    rows = lambda df: {tuple(r) for r in df.select("query_id", "rank", "vec_id", F.col("dist").cast("string")).collect()}
    for k in (3, 400):
        assert rows(S.knn(q, b, k, metric, own=own)) == plain_rank(d, k, "dist")
    assert rows(S.knn(q, b, 5, metric, limit=9, own=own)) == plain_rank(d, 5, "dist")
    pairs = lambda df: sorted(tuple(r) for r in df.select("query_id", "vec_id", F.col("dist").cast("string")).collect())
    assert pairs(S.pairs_within(q, b, 1.5, metric, own=own)) == pairs(d.filter("dist <= 1.5"))
    if metric == "l2_sq":
        key = F.floor(F.col("dist") * 10 + 0.5)
        assert rows(S.knn_by_key(q, b, 6, N.rounded(1), own=own)) == plain_rank(d.filter("dist < 1e9"), 6, key)
        biased = S.beta_biased(q, b, F.col("label") == 3, 0.8, 6, own=own)
        assert rows(biased) == plain_rank(d, 6, F.when(F.col("label") == 3, F.col("dist") * 0.8).otherwise(F.col("dist")))
        docs = S.first_documents(q, b, 3, "label", own=own)
        want = S.top_k(d.groupBy("query_id", "label").agg(F.min("dist").alias("dist")), 3, tie="label")
        assert sorted(map(str, docs.collect())) == sorted(map(str, want.select(docs.columns).collect()))
    d.unpersist()


@pytest.mark.parametrize("metric", sorted(set(N.MEASURES) - {"int_l2_sq"}))
def test_single_precision_bounds_lose_no_row_at_any_scale(metric):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 9)) * 10.0 ** rng.integers(-24, 24, (600, 1))
    x[300:340] = x[300] * (1 + 1e-9 * rng.standard_normal((40, 1)))
    x[340:600:2] = rng.standard_normal((130, 9))
    ids, of = np.arange(600), N.MEASURES[metric][0]
    q = N.Side(ids[::3], x[::3], metric, True)
    assert q.plus.dtype == np.float32
    assert q.plain.any() and not q.plain.all()
    near = N.Nearest(q, 5, metric, False, None)
    for a in range(0, 600, 100):
        near.add(N.Side(ids[a : a + 100], x[a : a + 100], metric, False), ids[a : a + 100])
    i, j = (m.ravel() for m in np.meshgrid(np.arange(200), ids, indexing="ij"))
    d = of(x[::3][i], x[j]).reshape(200, 600)
    d[np.arange(200), ids[::3]] = np.inf
    assert (near.ids == np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :5]).all()


def test_many_partitions_are_scanned_by_few_tasks(spark):
    n = spark.sparkContext.defaultParallelism
    assert N.spread(spark.range(100).repartition(16 * n)).rdd.getNumPartitions() == 4 * n
    assert N.spread(spark.range(100).repartition(n)).rdd.getNumPartitions() == n


def test_pairs_are_counted_without_listing_them(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERIES", 7)
    monkeypatch.setattr(N, "ROWS", 64)
    b = odd_vectors(spark)
    q = b.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    for metric, radius, own in (("l2_sq", 1.5, False), ("l2_sq", 0.0, True), ("l2", 1.5, False), ("cosine", 0.4, False)):
        assert N.count_within(q, b, radius, metric, own).first()["n"] == S.pairs_within(q, b, radius, metric, own=own).count()
    assert N.count_within(q, b, 1.5, own=False, limit=9).first()["n"] == S.pairs_within(q, b, 1.5, own=False).count()


def refused(monkeypatch, *names):
    def refuse(*args, **more):
        raise AssertionError("not this way")

    for name in names:
        monkeypatch.setattr(S, name, refuse)


def test_average_precision_lists_no_pairs(spark, monkeypatch):
    refused(monkeypatch, "pairs_within")
    assert catalog.queries()["average_precision"](spark, "/root/testdata/sf0.001").count() == 1


def test_coarse_rerank_recall_reads_the_table_by_large_blocks_only(spark, monkeypatch):
    refused(monkeypatch, "knn_arrow")
    assert catalog.queries()["coarse_rerank_recall"](spark, "/root/testdata/sf0.001").count() == 1


def test_candidate_construction_scans_once(spark, monkeypatch):
    scans, scan = [], S.best_rows
    monkeypatch.setattr(S, "best_rows", lambda *a, **more: scans.append(1) or scan(*a, **more))
    assert catalog.queries()["candidate_construction"](spark, "/root/testdata/sf0.001").count() == 25 * 25
    assert len(scans) == 1


def test_few_deleted_ids_shuffle_no_vectors(spark):
    b, gone = rows(spark, [[float(i), 0.0] for i in range(20)]), spark.range(5).withColumnRenamed("id", "vec_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, join in ((5, "BroadcastHashJoin"), (4, "SortMergeJoin")):
            kept = S.without(b, gone, limit)
            assert join in kept._jdf.queryExecution().executedPlan().toString()
            assert sorted(r["vec_id"] for r in kept.collect()) == list(range(5, 20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_broken_vectors_are_nobodys_neighbours(spark):
    q = rows(spark, [[0.0, 1.0]], "query_id", "qvec")
    b = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [0.0, 2.0]), (None, [0.0, 1.0])], "vec_id bigint, vec array<float>")
    assert [r["vec_id"] for r in S.knn(q, b, 3).collect()] == [3]


@pytest.mark.parametrize(
    "bad",
    [
        {"$or": []},
        {"$and": {"price": {"$eq": 1}}},
        {"price": {"$gte": "low"}},
        {"price": {"$lt": True}},
        {"colour": {"$in": ["red", "blue"]}},
        {"colour": "red"},
        {"$or": [{"$and": [{"$or": [{"price": {"$eq": 1}}]}]}]},
        {"$near": {"price": {"$eq": 1}}},
        {},
    ],
)
def test_filters_that_are_refused(bad):
    with pytest.raises(J.FilterError):
        J.parse(bad)


SHOP = '{"price":12,"weight":0.5,"sold":false,"colour":"red","size":{"wide":3,"unit":{"name":"cm"}},"tags":["a","b"]}'


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({"$and": [{"price": {"$gte": 12}}, {"$or": [{"colour": {"$eq": "blue"}}, {"size.wide": {"$lt": 4}}]}]}, True),
        ({"$and": [{"price": {"$gt": 12}}, {"colour": {"$eq": "red"}}]}, False),
        ({"price": {"$gt": 5, "$lte": 11}}, False),
        ({"price": {"$gt": 5}, "colour": "ignored"}, True),
        ({"$not": {"colour": {"$eq": "blue"}}}, True),
        ({"size.unit.name": {"$eq": "cm"}}, True),
        ({"size.unit.scale": {"$eq": "cm"}}, False),
        ({"$not": {"size.unit.scale": {"$eq": "cm"}}}, True),
        ({"depth": {"$ne": 1}}, False),
        ({"colour": {"$ne": "blue"}}, True),
        ({"price": {"$eq": 12.0}}, False),
        ({"weight": {"$eq": 0.5}}, True),
        ({"price": {"$lt": 12.5}}, True),
        ({"sold": {"$eq": False}}, True),
        ({"sold": {"$eq": 0}}, False),
    ],
)
def test_filter_semantics(spark, query, want):
    assert (J.matches(spark.createDataFrame([(SHOP,)], "p string"), query, "p").count() == 1) is want


def test_documents_that_are_no_json(spark):
    rows = spark.createDataFrame([("{broken",), (None,), ("",)], "p string")
    assert J.matches(rows, {"price": {"$ne": 1}}, "p").count() == 0
    assert J.matches(rows, {"$not": {"price": {"$eq": 1}}}, "p").count() == 3


def test_postings_refuse_not():
    with pytest.raises(J.FilterError):
        J.postings(None, J.parse({"a": {"$ne": 1}}), "id")


def test_rotated_codes():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((4, 64))
    c = x.mean(axis=0)
    assert np.allclose(np.linalg.norm(X.rotate(x, 5), axis=1), np.linalg.norm(x, axis=1))
    errors = []
    for bits in (0, 2, 4, 8):
        e = X.encode(x, c, 1, bits)
        d = X.distances(e, q[0], c, 1)
        exact = np.square(x - q[0]).sum(axis=1)
        errors.append(np.mean(np.abs(d.get("corrected", d["long"]) - exact) / exact))
        assert ((d["short_low"] <= exact + 1e-9) & (exact <= d["short_high"] + 1e-9)).all()
        assert (d["gate"] <= exact).mean() > 0.9
    assert errors == sorted(errors, reverse=True) and errors[0] < 0.03 and errors[-1] < 0.002


def recall_of(spark, name):
    exact = {tuple(r) for r in catalog.queries()["knn_l2"](spark, DATA).select("query_id", "vec_id").collect()}
    got = {tuple(r) for r in catalog.queries()[name](spark, DATA).select("query_id", "vec_id").collect()}
    return len(exact & got) / len(exact)


@pytest.mark.parametrize(("name", "least"), [("rotated_knn", 0.8), ("rotated_gate", 0.8), ("residual_rerank", 0.95), ("ivf_knn", 0.9), ("graph_beam_search", 0.9), ("graph_gated_search", 0.9), ("pq_adc_knn", 0.9)])
def test_approximate_recall(spark, name, least):
    assert recall_of(spark, name) >= least


def test_magnitudes_have_the_largest_cosine():
    rng = np.random.default_rng(4)
    u = rng.standard_normal((50, 16))
    cosine = lambda m: ((m + 0.5) * np.abs(u)).sum(axis=1) / np.sqrt(((m + 0.5) ** 2).sum(axis=1))
    got = cosine(X.magnitudes(u))
    for scale in np.linspace(0.05, 12, 4000):
        assert (cosine(np.clip(np.floor(np.abs(u) * scale), 0, 7)) <= got + 1e-12).all()


def test_bounds_and_symmetric_distances():
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((600, 64)), rng.standard_normal(64)
    x[0] = x[1] = 0.0
    c = np.zeros(64)
    e = X.encode(x, c, 1, 0)
    exact = np.square(x - q).sum(axis=1)
    d = X.distances(e, q, c, 1)
    assert (d["hard_low"][2:] <= exact[2:] + 1e-9).all() and np.isneginf(d["gate"][:2]).all() and (d["hard_low"] >= -1e-9).mean() > 0.9
    between = X.between_codes({k: v[2:100] for k, v in e.items()}, {k: v[100:] for k, v in e.items()})
    true = np.square(x[2:100, None] - x[None, 100:]).sum(axis=2)
    assert np.median(np.abs(between - true) / true) < 0.05
    assert np.array_equal(X.unpack_codes(X.pack_codes(e["codes"])), e["codes"])
    both = X.nested_layout(e["codes"], e["codes"] ^ 5)
    assert np.array_equal(both >> 4, e["codes"]) and np.array_equal(both & 15, e["codes"] ^ 5)
    tight, loose = (X.encode(x[2:], c, 1, 4, fit=f) for f in ("mse", "largest"))
    error = lambda e: np.abs(X.distances(e, q, c, 1)["corrected"] - exact[2:]).mean()
    assert error(tight) <= error(loose) * 1.1
    assert (X.error_scale(x[2:] / np.linalg.norm(x[2:], axis=1, keepdims=True), np.ones(598), "probabilistic") > 0).all()


@pytest.mark.parametrize("name", list(X.TRANSFORMS))
@pytest.mark.parametrize("dim", [64, 100])
def test_transforms_keep_lengths_and_products(name, dim):
    x = np.random.default_rng(6).standard_normal((20, dim))
    y = X.TRANSFORMS[name](x, 3)
    assert np.allclose(y @ y.T, x @ x.T)


def test_graph_changes(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 8))
    v = rows(spark, x).withColumn("part", F.col("vec_id") % 2)
    first = G.build(v.filter("vec_id < 300"), "part", 12, 30)
    grown = G.insert(v, first, "part", 12, 30)
    q = rows(spark, x[:40], "query_id", "qvec")

    def recall(vectors, graph, alive, **more):
        got = {(r["query_id"], r["vec_id"]) for r in G.search(vectors, graph, "part", q, 5, 40, own=False, **more).collect()}
        want = {(i, int(j)) for i in range(40) for j in [j for j in np.square(x - x[i]).sum(axis=1).argsort() if j != i and j in alive][:5]}
        return len(got & want) / len(want)

    everything, alive = set(range(400)), {i for i in range(400) if i < 40 or i % 3}
    assert {r[0] for r in grown.select("src").distinct().collect()} == everything
    assert recall(v, grown, everything) > 0.95 and recall(v, grown, everything, gate=True, patience=20) > 0.9
    some = v.filter(F.col("vec_id").isin(list(alive)))
    left = G.delete(v, grown, "part", some.select("vec_id"), 12)
    assert {r["dst"] for r in left.collect()} <= alive and recall(some, left, alive) > 0.95
    assert left.groupBy("src").count().agg(F.max("count")).first()[0] <= 12
    dropped = G.delete(v, grown, "part", some.select("vec_id"), 12, repair=False)
    assert {tuple(r) for r in dropped.select("src", "dst").collect()} <= {tuple(r) for r in grown.select("src", "dst").collect()}


def test_reachable_goes_on_until_there_is_no_more(spark):
    n = 130
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501)], "src bigint, dst bigint")
    start = spark.createDataFrame([(0,)], "node bigint")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        order = G.bfs_order(start, edges).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["node"], r["hop"], r["place"]) for r in order} == {(i, i, i) for i in range(n + 1)}
    nodes = spark.createDataFrame([(i,) for i in range(n + 3)], "node bigint")
    assert G.degree_stats(edges, nodes).first()["mean_degree"] == pytest.approx(n / (n + 3))


def test_widths_of_filtered_search(spark):
    c = spark.createDataFrame([(1, 30), (0, 9), (1, 2), (1, 10), (1, 100_000), (5, 9)], "m bigint, n bigint")
    assert [r[0] for r in c.select(S.adaptive_l(100, F.col("m"), F.col("n"), 10.0)).collect()] == [278, 1000, 100, 200, 1000, 100]


def test_range_phases_and_early_stop(spark):
    d = spark.createDataFrame([(0, i, float(i)) for i in range(10)] + [(1, i, 5.0 + i) for i in range(10)], "query_id bigint, vec_id bigint, dist double")
    got = lambda **more: sorted((r["query_id"], r["vec_id"]) for r in S.range_two_phase(d, 6.0, **more).collect())
    # query 1 has only two within the radius, so its first phase of three ends there
    assert got(l_size=3) == [(0, i) for i in range(7)] + [(1, 0), (1, 1)]
    assert got(l_size=3, inner=2.0, most=2) == [(0, 3), (0, 4), (1, 0), (1, 1)]
    assert got(l_size=50) == [(0, i) for i in range(7)] + [(1, 0), (1, 1)]
    for bad in ({"l_size": 0}, {"l_size": 1, "slack": 0.5}, {"l_size": 1, "inner": 7.0}, {"l_size": 1, "most": 0}):
        with pytest.raises(ValueError):
            got(**bad)
    hops = spark.createDataFrame([(0, 1, 5.0, 0), (0, 2, 4.0, 1), (0, 3, 6.0, 2), (0, 4, 7.0, 3), (0, 5, 1.0, 4)], "query_id bigint, vec_id bigint, dist double, hop bigint")
    assert [r["vec_id"] for r in S.early_stop(hops, 1, 2).orderBy("rank").collect()] == [2]
    assert [r["vec_id"] for r in S.early_stop(hops, 1, 3).orderBy("rank").collect()] == [5]


def test_prune_keeps_what_nothing_hides():
    x = np.array([[1.0, 0], [2.0, 0], [0, 3.0]])
    assert G.prune(x, np.zeros(2), np.arange(3), 3, 1.0) == [0, 2]


def test_bits_of_any_width(spark):
    rng = np.random.default_rng(8)
    for bits, n in ((1, 9), (3, 8), (3, 5), (5, 7), (7, 1), (12, 6)):
        codes = [int(c) for c in rng.integers(0, 1 << bits, n)]
        df = spark.createDataFrame([(codes,)], "c array<bigint>")
        packed = df.select(B.pack(F.col("c"), bits).alias("p"), B.unpack(B.pack(F.col("c"), bits), bits, n).alias("c")).first()
        whole = sum(c << (bits * k) for k, c in enumerate(codes))
        assert bytes(packed["p"]) == whole.to_bytes(-(-bits * n // 8), "little") and packed["c"] == codes


def test_half_floats(spark):
    df = spark.createDataFrame([(0, [0.1, 65504.0, 1e-9]), (1, None), (2, []), (3, [1e9])], "vec_id bigint, vec array<float>")
    got = {r["vec_id"]: r["vec"] for r in V.as_half(df, "vec").collect()}
    assert got[0] == [float(np.float16(np.float32(v))) for v in (0.1, 65504.0, 1e-9)] and got[1] is None and got[2] == [] and got[3] == [float("inf")]
    assert [r[0] for r in df.orderBy("vec_id").select(V.contains(F.col("vec"), F.lit(1e9).cast("float"))).collect()] == [False, False, False, True]


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_spherical_codes(spark, bits):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((500, 64))
    for metric in ("l2_sq", "ip_score"):
        q = H.Spherical(bits, metric=metric).fit(rows(spark, x))
        e = q.codes(x)
        assert e["codes"].min() >= 0 and e["codes"].max() < 2**bits
        found = q.search(q.encode(rows(spark, x)), rows(spark, x[:20], "query_id", "qvec"), 10, own=False).collect()
        exact = np.square(x[:20, None] - x[None]).sum(axis=2) if metric == "l2_sq" else -(x[:20] @ x.T)
        error = np.mean([abs(r["dist"] - exact[r["query_id"], r["vec_id"]]) for r in found])
        assert error < {1: 60, 2: 30, 4: 8, 8: 0.6}[bits] and len(found) == 200
    with pytest.raises(ValueError):
        H.Spherical(3)


def test_quantizers_share_an_interface(spark):
    x = np.random.default_rng(10).standard_normal((300, 64))
    for name in ("spherical_4", "product_1d", "rotated_4"):
        q = H.QUANTIZERS[name]().fit(rows(spark, x))
        found = q.search(q.encode(rows(spark, x)), rows(spark, x[:5], "query_id", "qvec"), 3)
        assert sum(r["query_id"] == r["vec_id"] for r in found.filter("rank = 1").collect()) >= 4


def test_scalar_codes_are_compensated(spark):
    x = np.random.default_rng(11).standard_normal((50, 8))
    sq = C.ScalarQuantizer.train(rows(spark, x), 8)
    df = rows(spark, x).withColumn("c", sq.codes(F.col("vec"))).withColumn("d", sq.decode(F.col("c")))
    pair = df.alias("a").join(df.alias("b"), F.col("a.vec_id") == F.col("b.vec_id") - 1)
    a, b = (F.col("a.c"), F.col("b.c")), (F.col("a.d"), F.col("b.d"))
    for coded, plain in ((sq.ip, V.ip), (sq.l2_sq, V.l2_sq), (sq.cosine, V.cosine_distance)):
        assert all(r[0] == pytest.approx(r[1], abs=1e-9) for r in pair.select(coded(*a), plain(*b)).collect())


def test_stored_files_are_files(spark, tmp_path):
    x = np.random.default_rng(12).random((40, 3), dtype=np.float32)
    table = files.write_binary(rows(spark, x), "vec", str(tmp_path / "table"))
    assert files.store(table, str(tmp_path / "out"), "fvecs") == table.count() > 0
    assert files.read_fvecs(spark, str(tmp_path / "out/*.fvecs")).count() == 40
    files.append_csv(spark.createDataFrame([(1, "a")], "n int, t string"), str(tmp_path / "csv"))
    files.append_csv(spark.createDataFrame([(2, "b,c")], "n int, t string"), str(tmp_path / "csv"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "csv"), "n int, t string").collect())) == [(1, "a"), (2, "b,c")]
    edges = spark.createDataFrame([(0, 0, 1)], "src bigint, pos int, dst bigint")
    files.save_index(str(tmp_path / "index"), {"bits": 4, "centre": [0.5]}, edges=edges, codes=rows(spark, x))
    model, tables = files.load_index(spark, str(tmp_path / "index"))
    assert model == {"bits": 4, "centre": [0.5]} and tables["codes"].count() == 40 and tables["edges"].collect() == edges.collect()
    (tmp_path / "truth.jsonl").write_text('{"query_id":1,"count":2,"ids":[3,4],"distances":[0.5,1.5]}\n')
    assert files.read_filter_truth(spark, str(tmp_path / "truth.jsonl")).first()["ids"] == [3, 4]


def test_id_hash_of_known_values(spark):
    def fnv(data):
        h = 14695981039346656037
        for byte in data:
            h = (h ^ byte) * 1099511628211 % 2**64
        return h - 2**64 if h >= 2**63 else h

    df = spark.createDataFrame([(0, [1, 2, 70000]), (1, []), (2, None)], "id bigint, ids array<bigint>")
    got = {r["id"]: r["hash"] for r in files.id_hash(df, "id", "ids").collect()}
    assert got == {0: fnv(np.array([1, 2, 70000], dtype="<u4").tobytes()), 1: fnv(b""), 2: fnv(b"")}


def test_generated_tables(spark):
    x = np.stack([r["vec"] for r in files.random_vectors(spark, 50, 16, 3, 2.0).orderBy("vec_id").collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), 2.0, atol=1e-5) and len(np.unique(x, axis=0)) == 50
    counts = {r["label"]: r["count"] for r in files.zipf_labels(spark, 20_000, 5, 1).groupBy("label").count().collect()}
    assert set(counts) == set(range(1, 6)) and 1.7 < counts[1] / counts[2] < 2.3


def test_postings_are_typed_and_change(spark):
    docs = spark.createDataFrame([(1, '{"a":42}'), (2, '{"a":"42"}'), (3, '{"a":42.5,"b":{"c":[true,{"d":null}]}}')], "id bigint, doc string")
    a = J.flatten(docs, "id", "doc")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(J.postings(a, J.parse({"a": {"$eq": 42}}), "id")) == [1] and ids(J.postings(a, J.parse({"a": {"$eq": "42"}}), "id")) == [2]
    assert ids(J.postings(a, J.parse({"a": {"$gte": 42}}), "id")) == [1, 3] and ids(J.postings(a, J.parse({"b.c.0": {"$eq": True}}), "id")) == [3]
    more = J.insert_postings(a, J.flatten(spark.createDataFrame([(4, '{"a":42}')], "id bigint, doc string"), "id", "doc"), "id")
    assert ids(J.postings(more, J.parse({"a": {"$eq": 42}}), "id")) == [1, 4]
    gone = J.delete_postings(more, spark.createDataFrame([(1,)], "id bigint"), "id")
    assert ids(J.postings(gone, J.parse({"a": {"$eq": 42}}), "id")) == [4]
    with pytest.raises(J.FilterError, match="already"):
        J.insert_postings(a, a, "id")
    with pytest.raises(J.FilterError, match="twice"):
        J.bitmap(docs, [(1, {"a": {"$eq": 1}}), (1, {"a": {"$eq": 2}})], "id", "doc")
    assert J.visit(J.parse({"$and": [{"a": {"$eq": 1}}, {"$not": {"b": {"$lt": 2}}}]}), lambda n, kids: 1 + sum(kids)) == 4


def test_runbooks(spark):
    steps = {1: {"operation": "insert", "start": 0, "end": 10}, 3: {"operation": "search"}, 4: {"operation": "delete", "start": 0, "end": 4}, 7: {"operation": "replace", "start": 5, "end": 6, "ids_start": 9}, 9: {"operation": "search"}}
    log = L.read_runbook(spark, steps, 10)
    v, q = rows(spark, [[float(i)] for i in range(10)]), rows(spark, [[0.0], [9.0]], "query_id", "qvec")
    kept = []
    found = L.run_stages(log, v, q, 1, lambda stage, alive: kept.append((stage, alive.count()))).collect()
    assert sorted((r["stage"], r["query_id"], r["vec_id"]) for r in found) == [(1, 0, 0), (1, 1, 9), (4, 0, 4), (4, 1, 5)] and kept == [(2, 6)]
    with pytest.raises(ValueError, match="more than"):
        L.read_runbook(spark, steps, 9)


def test_results_without_a_configuration_are_refused(spark):
    r = spark.createDataFrame([("a", 1), ("b", 2)], "config_id string, n int")
    with pytest.raises(KeyError):
        R.with_config(r, r.filter("config_id = 'a'"), ["config_id"])


def test_files_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).random((5, 3), dtype=np.float32)
    (tmp_path / "a.fvecs").write_bytes(files.encode_fvecs(x))
    (tmp_path / "a.ivecs").write_bytes(files.encode_ivecs([[1, 2], [3, 4]]))
    (tmp_path / "a.bin").write_bytes(files.encode_bin(x))
    (tmp_path / "a.graph").write_bytes(files.encode_graph([[1], [0, 2], []], 2, 1))
    for got in (files.read_fvecs(spark, str(tmp_path / "a.fvecs")), files.read_bin(spark, str(tmp_path / "a.bin"))):
        assert np.array_equal(np.array([r["vec"] for r in got.orderBy("row").collect()], dtype=np.float32), x)
    assert files.ground_truth(files.read_ivecs(spark, str(tmp_path / "a.ivecs")), 1).count() == 2
    assert [tuple(r) for r in files.read_graph(spark, str(tmp_path / "a.graph")).orderBy("src", "pos").collect()] == [(0, 0, 1, 1), (1, 0, 0, 1), (1, 1, 2, 1), (2, None, None, 1)]
    (tmp_path / "b.fvecs").write_bytes(files.encode_fvecs(x)[:-1])
    with pytest.raises(Exception, match="divide"):
        files.read_fvecs(spark, str(tmp_path / "b.fvecs")).count()


def test_stream_upserts_survive_replays(spark, tmp_path):
    log = QQ.mutations(spark, DATA).filter("op <> 'search'")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    L.upsert_stream(stream, str(tmp_path / "state"), str(tmp_path / "ck")).start().processAllAvailable()
    spark.streams.active[0].stop()
    got = {(r["id"], r["offset"]) for r in L.current(spark, str(tmp_path / "state")).collect()}
    assert got == {tuple(r) for r in L.active_at(log, 5).select("id", "offset").collect()}


def test_vector_set(spark):
    s = L.VectorSet(rows(spark, [[1, 0], [0, 1], [1, 1]]))
    assert s.card() == 3 and s.contains(2)
    s = s.remove(spark.createDataFrame([(2,)], "vec_id bigint"))
    assert s.card() == 2 and [r["vec_id"] for r in s.search([1.0, 0.1], 1).collect()] == [0]
    with pytest.raises(KeyError):
        s.search_by_element(2, 1)
