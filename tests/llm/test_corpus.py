"""Corpus operators against brute-force versions on small tables, edge cases included."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vectrail.llm import chat, language, mixing, neardup, neighbours, packing, privacy, quality, queries, tokens, wrappers

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"


def fixture_rows():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(90)) for _ in range(n))
    base = say(60)
    near = base.replace(base.split()[30], "other", 1)
    texts = [base, base, near, base + " tail", say(3000), None, "", " \n\t ", "one two", "ONE two", "a b c d e", "x" * 5000, "1 " * 3000, say(40) + " me.x@mail.example.com +49 (30) 1234567 10.0.0.255 300.1.1.1 4111 1111 1111 1111", "!!! 123", "\x01 a@b.co", "日本語 テキスト", "<|endoftext|> it's", "dup line here\ndup line here\nx"]
    out = [(i, t, "en" if i % 2 else "de", [None, "a", "b", "c"][i % 4], len(t or ""), 1) for i, t in enumerate(texts)]
    return [*out, out[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    want = sorted(con.sql(f"select {', '.join(names)} from ({queries.SQL[name]})").fetchall())
    assert sorted(tuple(r) for r in df.select(*names).collect()) == want


def test_quality_edges(docs, none):
    got = {r["doc_id"]: r for r in quality.quality_cascade(docs).collect()}
    assert got[5]["n_words"] == 0 and got[5]["base_failed"] and not got[5]["kept"]
    assert got[12]["n_repeat_words"] == 3000 and got[18]["n_dup_lines"] == 1
    assert got[0]["kept"] and not got[12]["kept"]
    assert quality.quality_cascade(none).count() == 0


def test_rules_go_by_rejections_per_cost(spark):
    rows = spark.createDataFrame([(i, "word " * 30 + ("!" * 40 if i % 2 else ""), 1, "x", 2) for i in range(200)], "doc_id bigint, text string, words int, row string, kept int")
    always, never, half = F.lit(True), F.lit(False), F.col("text").contains("!")
    rules = [quality.Rule("dear", always, F.lit(100)), quality.Rule("never", never, F.lit(1)), quality.Rule("half", half, F.lit(20)), quality.Rule("cheap", half, F.lit(10))]
    for _ in range(2):
        assert [(r.name, c, s) for r, c, s in quality.order_rules(rows, rules)] == [("cheap", 10.0, 0.5), ("half", 20.0, 0.5), ("dear", 100.0, 1.0), ("never", 1.0, 0.0)]
    # base counts of these rows reject nothing but by repeats, so the cascade's first rule is named
    few = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)) + " !", 7, "r", 8)], rows.schema)
    got = quality.quality_cascade(few, rules).first()
    assert (got["failed_rule"], got["words"], got["row"], got["kept"]) == ("cheap", 7, "r", False)
    costs = {r.name: c for r, c, _ in quality.order_rules(rows, quality.default_rules())}
    assert costs["capitals"] > costs["exclamations"] > costs["symbols"] and costs["stutter"] > costs["letters"]


def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


def test_token_counts(docs, none):
    t = library()
    want = sorted((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in fixture_rows())
    assert sorted(tuple(r)[:3] for r in tokens.count_tokens(docs).collect()) == want
    assert tokens.count_tokens(none).count() == 0


def test_packing_round_trip(docs, none):
    t = library()
    got = packing.pack_documents(docs, capacity=64, group=8).collect()
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in fixture_rows()}
    want = sorted((i, k, s, len(ids[i][s : s + 64]), zlib.crc32(np.array(ids[i][s : s + 64], dtype="<u4").tobytes())) for i in [r[0] for r in fixture_rows()] for k, s in enumerate(range(0, len(ids[i]), 64)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    full = defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none).count() == 0


def test_token_counts_of_unbroken_text(spark):
    rng = random.Random(3)
    t = library()
    texts = ["".join(rng.choice(a) for _ in range(n)) for n in (63, 64, 65, 500, 30_000) for a in ("a", "acgt", "abcdefghijklmnopqrstuvwxyz", ["ss", "the", "in", "é", "'s"])]
    texts.append("".join(rng.choice("abcdefghij") for _ in range(1_000_000)))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    lengths = sum(r["length"] for r in packing.pack_documents(df).collect())
    assert lengths == sum(got.values()) + len(texts)


def test_packing_encodes_as_the_library(monkeypatch):
    t = library()
    enc = packing.Encoder(tokens.vocabulary_path())
    rng = random.Random(17)
    signs = [*"abzAZ019 .,!'-_<|>\n  éÉÀßþÞÿ×÷ªµ²½\xa0\x85\xad\t\r\x0b\x00\u0300\u0301İıΣςжЖ日本🙂\u200d", "'s", "'LL", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "ÉCOLE", "</w>", "the"]
    texts = ["", " \n ", "x" * 500, *("".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)), *(f"ab{chr(c)}cd {chr(c)} A{chr(c)}" for c in range(0x600))]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    for block in (packing.BLOCK, 7, 1000):
        monkeypatch.setattr(packing, "BLOCK", block)
        assert enc.encode(texts) == want
    assert enc.encode([]) == []


def test_packing_encodes_runs_once():
    rng = random.Random(19)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäé", k=9)) for _ in range(200)]
    texts = [" ".join(a + case(w) + b for w in words for case in (str.lower, str.upper, str.capitalize)) for a in ("", "(", '"', "#") for b in ("", ".", ",", "!!", "###", ")", "7")]
    enc = packing.Encoder(tokens.vocabulary_path())
    assert enc.encode(texts) == [np.array(library().encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    # 16,800 different pieces between spaces
    assert len(enc.seen) < 250


def brute_packing(lengths, capacity):
    """Gaps of all bins by trying every choice and summing squares of counts of open bins."""
    gaps = []
    for n in lengths:
        def cost(gs):
            return sum(gs.count(g) ** 2 for g in set(gs) if g)
        options = [(cost([*gaps[:i], g - n, *gaps[i + 1 :]]), g, i) for i, g in enumerate(gaps) if g >= n]
        fresh = cost([*gaps, capacity - n])
        if options and min(options)[0] <= fresh:
            i = min(options)[2]
            gaps[i] -= n
        else:
            gaps.append(capacity - n)
    return gaps


def test_packing_follows_sums_of_squares():
    rng = random.Random(13)
    for capacity in (7, 20):
        for _ in range(15):
            lengths = sorted((rng.randrange(1, capacity + 1) for _ in range(60)), reverse=True)
            bins, offsets, gaps = packing.sum_of_squares(np.array(lengths), capacity)
            assert sorted(gaps) == sorted(brute_packing(lengths, capacity))


def test_packing_uses_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, group=512).collect()
    total, used = sum(r["length"] for r in rows), len({r["sequence_id"] for r in rows})
    assert used <= 1.01 * total / 4096 + 2


def brute_neighbours(rows, q, k=10):
    """(vec_id, distance) of the k nearest rows of q's id and vector, nearest first."""
    i, v = q
    d = sorted({(float(np.sqrt(np.square(np.array(x) - np.array(v)).cumsum()[-1])), j) for j, x in rows if j != i and len(x) == len(v)})
    return [(j, far) for far, j in d[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    good = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    good += [(1004, good[7][1]), (1005, good[7][1]), (1020, good[20][1]), (20, good[30][1]), good[40]]
    good += [(2000 + 20 * i, [float(v) for v in rng.standard_normal(3)]) for i in range(6)] + [(3000, [1.0])]
    bad = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16)]
    df = spark.createDataFrame([(i, v, 0, 0.0) for i, v in good + bad], "vec_id bigint, embedding array<double>, score int, h double")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=100, block_rows=7)
    got = defaultdict(list)
    for r in found.collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert not {v for g in got.values() for _, v, _ in g} & {i for i, _ in bad} and not set(got) & {1000, 3000}
    hits = total = 0
    for i, v in good:
        if i % 20 == 0 and i not in (20, 3000):  # two vectors have the id 20
            want, mine = brute_neighbours(good, (i, v)), sorted(got[i])
            assert [m[0] for m in mine] == list(range(1, len(want) + 1))
            far = {j: float(np.sqrt(np.square(np.array(y) - np.array(v)).cumsum()[-1])) for j, y in good if len(y) == len(v) and j != 20}
            assert all(s == far[j] for _, j, s in mine if j != 20) and mine == sorted(mine, key=lambda m: (m[2], m[1]))
            hits += len({j for j, _ in want} & {m[1] for m in mine})
            total += len(want)
    assert len(got[20]) == 20 and hits / total >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_a_hot_vector_and_clusters(spark):
    """A third of the rows share one vector; of clustered vectors few distances are computed, in many tasks."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 24)) * 4
    x = centres[rng.integers(0, 60, 2000)] + 0.3 * rng.standard_normal((2000, 24))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000 + i, [1.5] * 24) for i in range(1000)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, shard_rows=150, block_rows=20).collect()
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    assert all(got[5000 + i] == [j for j in range(5000, 5011) if j != 5000 + i][:10] for i in range(0, 1000, 20))
    queries = range(0, 2000, 100)
    assert np.mean([len({j for j, _ in brute_neighbours(rows[:2000], rows[q])} & set(got[q])) / 10 for q in queries]) >= 0.9
    assert np.mean([r["n_compared"] for r in found if r["query_id"] < 2000]) < 0.15 * 2000


def test_recall_of_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], [float(v) for v in r["embedding"]]) for r in df.collect()]
    got = defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 5 == 0, shard_rows=100, block_rows=9).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert np.mean([len({j for j, _ in brute_neighbours(rows, (i, v))} & got[i]) / 10 for i, v in rows if i % 5 == 0]) >= 0.9


def test_main_text(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?p>|</?h1>", article))
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_pages_with_other_layouts(spark):
    page = "<body><nav>menu</nav><div class='cookie-notice'>ok?</div><main><h2>T&eacute;st</h2><p>One <i>two</i>\n three<ul><li>a<li>b</ul><div id=comments><p>mine</p></div><form>go</form><script>x</script></main><footer>f</footer>"
    df = spark.createDataFrame([(1, "http://h/1", page, 0), (2, None, None, 0), (3, "x", "", 0), (4, "x", "<!-- open <p>no", 0), (5, "x", "plain &amp; text", 0)], "page_id bigint, url string, html string, extra int")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()}
    assert got == {1: "Tést\n\nOne two three\n\na\n\nb", 2: "", 3: "", 4: "", 5: "plain & text"}
    assert wrappers.extract_pages(df.limit(0)).count() == 0


def extracted(spark, rows):
    got = wrappers.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: r["text"] for r in got}


def test_copies_of_a_page_are_no_template(spark):
    page = lambda t, p: f"<body><article><h1>{t}</h1><p>{p}</p></article><div>All rights reserved</div></body>"
    rows = [(None, "http://h/a", page("Same", "one text"))] * 20 + [(i, "http://h/b", page(f"Title {i}", f"text {i}")) for i in range(3)]
    plain = lambda t: f"<body><div>All rights reserved</div><h1>Title</h1><p>{t}</p></body>"
    want = {None: "Same\n\none text"} | {i: f"Title {i}\n\ntext {i}" for i in range(3)}
    for n in (1, 2, 3, 8):  # equal pages of a host: one content, however many
        rows += [(100 * n + i, f"http://copies{n}/", page("Same", "one text")) for i in range(n)] + [(100 * n + 50 + i, f"http://plain{n}/", plain("one text")) for i in range(n)]
        want |= {100 * n + i: "Same\n\none text" for i in range(n)} | {100 * n + 50 + i: "All rights reserved\n\nTitle\n\none text" for i in range(n)}
    rows += [(1000 + i, "http://different/", plain(f"text {i} " * 9)) for i in range(2)]
    want |= {1000 + i: "Title\n\n" + (f"text {i} " * 9).strip() for i in range(2)}
    assert extracted(spark, rows) == want


def test_what_an_article_keeps(spark):
    inner = "<header class='post-header'><h1>Title</h1></header><p><a href=x>link paragraph</a></p><p>tail text</p><figure><img><figcaption>caption</figcaption></figure><fieldset><label>label</label></fieldset>"
    out = "<div class='comments'><article><p>mine, and much longer than all the text of the article itself, that is for sure, yes</p></article></div><form>form</form><nav>menu</nav>"
    want = "Title\n\nlink paragraph\n\ntail text\n\ncaption\n\nlabel"
    rows = [(1, "http://a/", f"<div class='with-sidebar widget-page sidebar'><article>{inner}{out}</article>{out}</div>"), (2, "http://b/", f"<div class=page><main>{inner}{out}</main></div>")]
    rows += [(3, "http://c/", "<div class=with-sidebar><div><p>only text</p></div><div class=sidebar>no</div></div>"), (4, "http://d/", "<div class=widget><p>only text</p></div>"), (5, "http://e/", "<main><p>long text of the page is here, and more of it</p><article>teaser</article></main>")]
    assert extracted(spark, rows) == {1: want, 2: want, 3: "only text", 4: "only text", 5: "long text of the page is here, and more of it\n\nteaser"}


def test_long_and_deep_pages(spark):
    rows = [(1, "http://a/", "<div>" * 10_000 + "<p>deep</p>"), (2, "http://a/", "<p>before</p>" + '<a "' * 250_000), (3, "http://a/", "<div>t" * 5_000 + "</section>" * 5_000), (4, "http://b/", "<h2>a</h2><p>b</p>" * 10_000)]
    rows += [(5, "http://c/", "".join(f"<x{i}>a</x{i}>" for i in range(5_000))), (6, "http://c/", "<p>" * 20_000 + "x" * 1_000_000)]
    got = extracted(spark, rows)
    assert got[1] == "deep" and got[2] == "before" and got[3].split("\n\n") == ["t"] * 5_000
    assert got[4].split("\n\n") == ["a", "b"] * 10_000 and got[5].split("\n\n") == ["a"] * 5_000 and got[6] == "x" * 1_000_000


def test_main_element_is_asked_of_pages_that_have_it(spark):
    kinds = {"a": "<article><p>text {0}</p></article><p>beside</p>", "b": "<div class=content><p>text {0}</p></div>", "c": "<main><p>text {0}</p></main><div>beside {0}</div>"}
    rows = [(i, "http://h/", "<body><nav>menu</nav>" + kinds["aaab"[i % 4] if i < 40 else "c"].format(i) + "</body>") for i in range(44)]
    got = wrappers.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(i, f"text {i}") for i in range(44)]


def test_wrapper_is_a_union_free_expression():
    said = lambda *pages: wrappers.expression(wrappers.infer(list(pages)))
    assert said("<ul><li>x<li>y</ul><p>one", "<ul><li>z</ul><h2>t</h2><p>two<p>three") == "<ul>(<li>#</>)+</>(<h2>#</>)?(<p>#</>)+"
    group = said("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><div>e</div>", "<h2>a</h2><p>b</p>")
    assert group == "((<h2>#</>)+(<p>#</>)+)+(<div>#</>)?"


def test_pages_are_parsed_by_wrappers():
    wrapper = wrappers.read(wrappers.written(wrappers.infer(["<div><p>a</p></div><p>b</p><ul><li>c<li>d</ul>", "<div><p>a</p></div><h2>t</h2><p>b</p>"])))
    nodes = wrappers.nodes_of("<div><p>x</p></div><p>y</p><ul><li>1<li>2<li>3</ul><h6>z</h6>")
    wrappers.parse(wrapper, nodes[0])
    slots = {n.text: n.slot for n in nodes if n.text is not None}
    # both paragraphs have a slot of their own, list items share one, and what the wrapper lacks has none
    assert len({slots["x"], slots["y"], slots["1"]}) == 3 and slots["1"] == slots["2"] == slots["3"] and slots["z"] == -1


def test_slots_after_many_different_parts_are_judged_over_the_host(spark):
    """Parts of one element beyond the 256th are in the wrapper too, on one page and where pages are aligned."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    row = lambda p, i: f"<section class='{name(i)}'>page {p} tells its own story number {i}</section>"
    tail = "<section class='tail'>the same closing words on all pages of the host</section>"
    many = [(p, "http://many/", "".join(row(p, i) for i in range(400)) + tail) for p in range(3)]
    # 200 parts a page, 600 in all
    apart = [(10 + p, "http://apart/", "".join(row(p, i) for i in range(200 * p, 200 * p + 200)) + tail) for p in range(3)]
    df = spark.createDataFrame(many + apart, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.extract_pages(df).collect()}
    for p in range(3):
        assert got[p].split("\n\n") == [f"page {p} tells its own story number {i}" for i in range(400)]
        assert got[10 + p].split("\n\n") == [f"page {p} tells its own story number {i}" for i in range(200 * p, 200 * p + 200)]
    wide = "".join(f"<section class='{name(i)}'>x</section>" for i in range(600))
    assert len(wrappers.infer([wide, wide + tail]).kids) == 601


def test_wrappers_of_many_shapes_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 3)
    rows = [(i, "http://h/", f"<body><div>All rights reserved</div><div class=k{'x' * (i % 20)}><p>text {i} is here, and long enough</p></div></body>") for i in range(40)]
    assert extracted(spark, rows) == {i: f"text {i} is here, and long enough" for i in range(40)}


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<", "|", "\\", "s>", "/s>", "[", "INST]", "/INST]", "<<SYS>>", "<|end|>", "<|turn|>", "<|says|>", "x", "\n", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", None, "a\n<|says|>"]), rng.choice([None, "", *("".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(5))]), 0) for c in range(150) for t in range(rng.randrange(1, 5))]
    df = spark.createDataFrame([*rows, rows[0]], "conv_id bigint, turn bigint, role string, text string, extra int")
    done = chat.format_chats(chat.canonical_turns(df))
    for r in done.select("turns", chat.read_back(F.col("formatted")).alias("back"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect():
        assert r["turns"] == r["back"]
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert r["formatted"].count("<|turn|>") == len(r["turns"])
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_layouts_by_fingerprint(spark):
    rows = [(1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'), (2, '{"instruction":"x","input":"y","output":"z"}'), (3, '{"q":1}'), (4, "nonsense"), (5, '{"conversations":[{"from":"human","value":"h"}]}'), (6, None)]
    got = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.canonical_records(spark.createDataFrame(rows, "conv_id bigint, record string")).collect()}
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "x\n\ny"), ("assistant", "z")], 3: None, 4: None, 5: [("user", "h")], 6: None}
    pairs = spark.createDataFrame([(1, "p", "r")], "conv_id bigint, prompt string, response string")
    assert [tuple(t) for t in chat.canonical_turns(pairs).first()["turns"]] == [("user", "p"), ("assistant", "r")]
    with pytest.raises(ValueError, match="no layout"):
        chat.canonical_turns(pairs.withColumnRenamed("prompt", "what"))
    named = pairs.withColumns({"turns": F.lit(1), "t": F.lit(2), "turn": F.lit(3)})
    assert [tuple(t) for t in chat.canonical_turns(named).first()["turns"]] == [("user", "p"), ("assistant", "r")]


def test_rows_reach_their_layout_by_fingerprint(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, "assistant", "b", 5, 6), (1, 0, "user", "a", 5, 6)], "conv_id bigint, turn int, role string, text string, answer int, turns int")
    assert chat.layout_of(chat.field_paths(rows.schema)) == chat.ROW_LAYOUT
    assert [tuple(t) for t in chat.canonical_turns(rows).first()["turns"]] == [("user", "a"), ("assistant", "b")]
    monkeypatch.delitem(chat.LAYOUTS, chat.ROW_LAYOUT)
    with pytest.raises(ValueError, match="no layout"):
        chat.op5_chat_formatting(spark, DATA)


def test_one_conversation_of_many_turns_and_long_texts(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"<|end|> {k}") for k in range(3000)] + [(2, 0, "assistant", "[/INST] " * 100_000)]
    done = chat.format_chats(chat.canonical_turns(spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")))
    got = {r["conv_id"]: r["loss"] for r in done.select("conv_id", chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got == {1: "".join(t for c, _, r, t in turns if c == 1 and r == "assistant"), 2: turns[-1][3]}


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_with_chains(spark, docs, none):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(r[0], r[1]) for r in fixture_rows()]
    for k in range(40):  # a chain of small edits, whose ends are far apart
        words[rng.randrange(60)] = f"n{k}"
        rows.append((100 + k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_components(rows)
    assert neardup.near_duplicates(none).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = np.unique(pool[:800]), np.unique(pool[100:900])
    s = neardup.sketches([a, b, np.unique(pool[:900])])
    assert (np.maximum(s[0], s[1]) == s[2]).mean() > 0.99  # sketches merge by maximum
    j = neardup.estimate(s[:1], s[1:2], np.array([800.0]), np.array([800.0]))[0]
    assert abs(j - 700 / 900) < 0.12


def test_language(spark, docs, none):
    samples, weights = language.learn_samples(spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    got = language.identify(rows, samples, weights, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    edge = {r["doc_id"]: r for r in language.identify(docs, samples, weights, ["doc_id"]).collect()}
    assert all(edge[i]["lang_pred"] == "und" and edge[i]["score"] == 0 for i in (5, 6, 7, 12))
    assert language.identify(docs, {}, {}, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert language.learn_samples(none) == ({}, {})


def brute_phrases(text, sample):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i, n = i + max(1, k - 1), n + 1
    return n


def brute_language(parser, samples, text):
    """Language and score by longest matches looked up as substrings."""
    as_text = lambda t: "".join(map(chr, parser.encode(t).tolist()))
    need = []
    for x in parser.languages:
        known = as_text(samples[x])
        need.append(brute_phrases(as_text(text), known) * np.log2(len(known) + 2))
    best, second = np.sort(need)[:2]
    return parser.languages[int(np.argmin(need))], 1 - best / max(second, 1e-9) if second else 0.0


@pytest.mark.parametrize("dense", [language.DENSE, 0])
def test_predictions_equal_brute_force(monkeypatch, dense):
    monkeypatch.setattr(language, "DENSE", dense)
    rng = random.Random(6)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(n))
    # the second language has little labelled text, the third very many letters
    samples = {"a": say("aabbcde", 400), "b": say("abbffgg", 60), "c": say([chr(0x4E00 + k) for k in range(600)], 500)}
    parser = language.CrossParser(samples, {"a": 3, "b": 2, "c": 1})
    texts = [say("aabbcdefg", n) for n in (1, 5, 60, 300)] + [samples["b"][40:300] + " zz 日本", samples["c"][:900] * 2, "ab " * 900, samples["a"][:255], samples["a"][:256], samples["a"][7:1300]]
    names, scores = parser.predict(texts)
    for t, name, score in zip(texts, names, scores, strict=True):
        assert (name, pytest.approx(score, abs=1e-9)) == brute_language(parser, samples, t)


def test_ties_of_languages():
    parser = language.CrossParser({"b": "same text", "a": "same text", "c": "same text"}, {"a": 1, "b": 2, "c": 2})
    assert parser.predict(["some text", "", "123", "\x00x"]) == (["b", "und", "und", "b"], [0.0] * 4)


def test_held_out_accuracy(spark):
    from vectrail.llm.language import op7_language_id

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = [r for r in op7_language_id(spark, "/root/testdata/sf0.01").collect() if r["held_out"] and truth[r["doc_id"]]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(got) > 100
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.98


def test_learning_takes_whole_texts_of_bounded_rows(spark):
    rows = [(i, f"text{i} " * 20, "x") for i in range(400)] + [(1000, "y" * 9000, "y"), (1001, "z" * 9500, "y"), (1002, None, "y"), (1003, "q", None)]
    samples, weights = language.learn_samples(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample_docs=50, sample_chars=1000)
    texts = {t for _, t, _ in rows}
    assert set(samples) == {"x", "y"} and samples["y"] == "y" * 9000 or samples["y"] == "z" * 9500
    assert weights["x"] < 50 and all(p.strip() + " " in texts for p in samples["x"].split("  "))


def brute_spans(t):
    def luhn(x):
        return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, x[::-1]))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        x = re.sub("[^0-9]", "", m[0])
        if 16 <= len(x) <= 19 and luhn(x):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_personal_data(spark, docs, none):
    odd = [(200, "a.b@c.d_e@f.g x@@y 1.2.3.4.5.6.7.8 +1 (2) 3456789"), (201, "9" * 30000), (202, "a." * 20000), (203, "é 4111-1111-1111-1111 000.1.02.3")]
    rng = random.Random(4)
    odd += [(300 + i, "".join(rng.choice("a@.1 0+-()9é") for _ in range(80))) for i in range(60)]
    rows = [(r[0], r[1]) for r in fixture_rows()] + odd
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = dict(rows)
    for r in privacy.find_spans(df).select("doc_id", "base").collect():
        assert [tuple(s) for s in r["base"]] == brute_spans(texts[r["doc_id"]] or "")
    assert privacy.find_spans(none).count() == 0


def test_disclosing_terms_and_redaction(spark):
    rows = [(i, f"note {i} from Zaphod here write zap{i % 2}@mail.example.com please x{i}") for i in range(6)] + [(10 + i, f"plain note number {i} here please") for i in range(60)]
    rows = [(i, t.replace("zap0", "zap").replace("zap1", "zap")) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = privacy.find_spans(df).select("doc_id", "spans", privacy.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    for r in found:
        if r["doc_id"] < 6:
            assert "Zaphod" not in r["t"] and "[TERM]" in r["t"] and "[EMAIL]" in r["t"] and "note" in r["t"] and "please" in r["t"]
        else:
            assert not r["spans"]


def test_entity_of_one_document_is_disclosed(spark):
    rows = [(1, "please write to Zaphod at zap@mail.example.com soon"), (2, "call Trillian on +49 30 1234567 soon"), (3, "call Trillian on +49 30 1234567 please")]
    rows += [(10 + i, "please write to or call at any mail soon on") for i in range(300)]
    found = privacy.find_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    terms = {r["doc_id"]: {r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"} for r in found}
    assert (terms[1], terms[2], terms[3]) == ({"Zaphod"}, {"Trillian"}, {"Trillian"})
    assert not any(terms[i] for i in terms if i >= 10)


def test_terms_far_from_the_entity_are_spans(spark):
    far = " please write to any" * 40
    rows = [(1, f"Zaphod{far} zap@mail.example.com{far} Zaphod"), (2, f"zap@mail.example.com Zaphod{far}"), (3, f"{far} Trillian {far} +49 30 1234567")]
    rows += [(10 + i, "please write to or call at any mail soon on") for i in range(300)]
    found = privacy.find_spans(spark.createDataFrame(rows + rows[:1], "doc_id bigint, text string")).filter("doc_id < 10").collect()
    terms = {r["doc_id"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"] for r in found}
    assert len(found) == 4 and terms == {1: ["Zaphod"] * 2, 2: ["Zaphod"], 3: ["Trillian"]}


def brute_terms(rows, disclosure, prior):
    """Flagged (row, term) by counting over all documents."""
    words = [{w.lower() for w in re.findall(r"[^\W\d_]{3,}", t or "")} for t in rows]
    entities = [{(k, t[a:b]) for k, a, b in brute_spans(t or "")} for t in rows]
    n = len(rows)
    out = set()
    for e in set().union(*entities):
        at = [i for i in range(n) if e in entities[i]]
        own = np.log(n / len(at))
        for w in set().union(*(words[i] for i in at)):
            both, all_ = sum(w in words[i] for i in at), sum(w in x for x in words)
            pmi = np.log((both + prior * len(at) / n) / (all_ + prior)) + own
            if own > 0 and pmi >= disclosure * own:
                out |= {(i, w) for i in at if w in words[i]}
    return out


def test_terms_equal_brute_force(spark):
    rng = random.Random(11)
    names = [f"name{chr(97 + k)}" for k in range(20)]
    rows = []
    for i in range(400):
        text = [rng.choice("please write call soon mail again today here and there".split()) for _ in range(20)]
        if i % 3 == 0:
            k = rng.randrange(20)
            text += [names[k], f"{names[k]}@mail.example.com"]
        if rng.random() < 0.1:
            text.append(rng.choice(names))
        rng.shuffle(text)
        rows.append(" ".join(text))
    want = {(i, w) for i, w in brute_terms(rows, privacy.DISCLOSURE, privacy.PRIOR)}
    found = privacy.find_spans(spark.createDataFrame([*enumerate(rows)], "doc_id bigint, text string")).collect()
    clear = lambda r, s: not any(b["start"] < s["end"] and s["start"] < b["end"] for b in r["base"])
    got = {(r["doc_id"], r["text"][s["start"] : s["end"]].lower()) for r in found for s in r["spans"] if s["kind"] == "term"}
    # a term that occurs only inside base spans has no span of its own
    alone = {(r["doc_id"], m[0].lower()) for r in found for m in re.finditer(r"[^\W\d_]{3,}", r["text"]) if clear(r, {"start": m.start(), "end": m.end()})}
    assert got == want & alone and len(got) > 50


def test_very_many_spans_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.co, " * 20_000, 1, 2, 3), (None, "x.y@z.org", 1, 2, 3)], "doc_id bigint, text string, row int, terms int, n int")
    found = privacy.find_spans(df.withColumn("base", F.lit(4)), ("b", "s"))
    got = {r["doc_id"]: (len(r["b"]), r["t"], r["row"], r["terms"], r["base"]) for r in found.select("*", privacy.redact(F.col("text"), F.col("s")).alias("t")).collect()}
    assert got == {1: (20_000, "[EMAIL], " * 20_000, 1, 2, 4), None: (1, "[EMAIL]", 1, 2, 4)}


def test_redaction_of_overlapping_spans(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        t = "".join(rng.choice("abé日 ") for _ in range(40))
        rows.append((i, t, sorted((a := rng.randrange(39), rng.randrange(a + 1, 41), rng.choice("xy")) for _ in range(rng.randrange(25)))))
    df = spark.createDataFrame([(i, t, [(k, a, b) for a, b, k in sp]) for i, t, sp in rows], f"i int, text string, spans {privacy.SPANS}")
    got = {r["i"]: r["t"] for r in df.select("i", privacy.redact(F.col("text"), F.col("spans")).alias("t")).collect()}
    for i, t, sp in rows:
        out, end = "", 0
        for a, b, k in sp:
            if a >= end:
                out += t[end:a] + f"[{k.upper()}]"
            end = max(end, b)
        assert got[i] == (out + t[end:] if sp else t)


def test_mix(spark, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text")
    sizes = mixing.sizes_of(docs)
    got = mixing.mix_sizes(sizes, leaf_rows=3).collect()
    want = sorted((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in docs.collect())
    assert sorted((r["doc_id"], r["size"]) for r in got) == want
    total, per = defaultdict(int), defaultdict(int)
    for r in got:
        total[r["source"]] += r["size"]
        per[r["source"]] += r["copies"] * r["size"]
        assert 0 <= r["copies"] <= 3
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s)))}
    target, left = {}, set(total)
    while True:  # shares, the excess over the cap dealt out again until none is above
        free = sum(total.values()) - sum(target.values())
        share = {s: free * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in over}
        left -= over
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
    largest = max(s for _, s in want)
    assert all(abs(per[s] - target[s]) <= largest for s in total)
    again = mixing.mix_sizes(sizes.repartition(7), leaf_rows=3).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix_sizes(mixing.sizes_of(none)).count() == 0


def test_mix_of_odd_rows(spark, docs):
    odd = docs.withColumns({"copies": F.lit(7), "size": F.lit(8), "at": F.lit(9)})
    many = odd.unionByName(odd.filter("doc_id = 4").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(5000)))).drop("again"))
    taken = mixing.take_copies(many)
    assert taken.columns == odd.columns
    got = {r["doc_id"]: r["n"] for r in taken.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    plan = defaultdict(list)
    for r in mixing.mix_sizes(mixing.sizes_of(many)).collect():
        plan[r["doc_id"]].append(r["copies"])
    # as many rows as the plan has, repeated rows getting nearly equal numbers
    assert got == {i: sum(c) for i, c in plan.items() if sum(c)} and len(plan[4]) == 5001
    assert all(max(c) - min(c) <= 1 and max(c) <= 3 for c in plan.values())


def test_many_sources_and_levels(spark):
    rng = random.Random(8)
    rows = [(i, f"s{rng.randrange(300):03}" if i % 50 else None, rng.choice([0, 1, 5, 400])) for i in range(3000)]
    total = defaultdict(int)
    for _, s, n in rows:
        total[s] += n
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(total, key=lambda s: (s is None, s)))}
    target, left = {}, set(total)
    while left:
        free = sum(total.values()) - sum(target.values())
        level = free / sum(weight[x] for x in left)
        over = {s for s in left if level * weight[s] > 3 * total[s]}
        target |= {s: 3.0 * total[s] if over else level * weight[s] for s in over or left}
        left -= over or left
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint").withColumn("n_rows", F.lit(1))
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert set(got) == set(target) and all(got[s] == pytest.approx(target[s]) for s in target)


def test_pivotal_keeps_sums():
    p = np.full(101, 0.37)
    out = mixing.pivotal(p, np.arange(101), 0)
    assert out.sum() == pytest.approx(p.sum()) and ((out > 0) & (out < 1)).sum() <= 1


def test_pipeline(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    # columns with the names of the operators' results, a row twice, and null ids
    extra = {c: F.lit(7) for c in ("score", "lang_pred", "copies", "base", "spans", "_r", "_size", "at", "row", "terms", "own", "hashed", "label", "rep", "th")}
    rows = rows.withColumns(extra).withColumn("doc_id", F.when(F.col("doc_id") % 40 == 3, None).otherwise(F.col("doc_id")))
    rows = rows.unionByName(rows.filter("doc_id = 1 or doc_id is null"))
    docs, kept = rows, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == rows.columns and docs.filter("score <> 7 or copies <> 7 or base <> 7").isEmpty()
        if name == "near_dedup":
            kept = docs.collect()
    said = [(r["doc_id"], r["text"]) for r in rows.distinct().collect() if any(c.isalpha() for c in r["text"] or "")]
    label = brute_components([(i, t) for i, (_, t) in enumerate(said)])
    groups = defaultdict(list)
    for i, (_, c) in label.items():
        groups[c].append(said[i])
    want = [min((d for d, _ in g if d is not None), default=None) for g in groups.values()]
    key = lambda d: (d is None, d)
    assert sorted((r["doc_id"] for r in kept), key=key) == sorted(want, key=key)
    clean = docs.collect()
    assert not any(brute_spans(r["text"]) for r in clean)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert sum(r["piece"] == 0 for r in packed) == len(clean)
    full = defaultdict(list)
    for r in packed:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in full.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096


def test_pipeline_of_no_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_near_duplicates_of_shared_and_null_ids(spark):
    say = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    rows = [(5, say("a")), (5, say("b")), (3, say("b") + " tail"), (9, say("a") + " more"), (None, say("b")), (None, say("c")), (None, say("c")), (None, say("c") + " end"), (7, None), (7, ""), (None, None), (8, say("d")), (8, say("d"))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, th string, keeper int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=repr)
    n = {t: len(shingles(t)) for _, t in rows}
    comp = lambda i, t: i if not n[t] else 8 if i == 8 else None if t.startswith("c") else 3
    assert got == sorted(((i, n[t], comp(i, t), i is not None and comp(i, t) == i) for i, t in rows), key=repr)
    left = sorted((tuple(r) for r in neardup.keep_one(df).select("doc_id", "text", "th", "keeper").collect()), key=repr)
    c = [x for x in left if x[1] and x[1].startswith("c")]
    assert len(c) == 1 and sorted((x for x in left if x not in c), key=repr) == sorted([(3, say("b") + " tail", "x", 1), (7, None, "x", 1), (7, "", "x", 1), (None, None, "x", 1), (8, say("d"), "x", 1)], key=repr)


def test_near_boilerplate_in_many_components(spark):
    """Short documents that share most words, but not enough, fall in the same buckets and stay apart, and a few links among them are found."""
    template = [f"t{i}" for i in range(24)]
    rows = [(k, " ".join([*template, f"x{k}", f"y{k}", f"z{k}", f"u{k}", f"v{k}", f"w{k}"])) for k in range(1500)]
    rows += [(5000 + k, rows[k][1] + " end") for k in range(0, 1500, 100)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in rows}


def test_digests_are_hex(spark):
    r = privacy.op8_personal_data(spark, DATA).filter("n_email + n_ip + n_card + n_phone = 0").first()
    assert r["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_linked_sets_meet_in_their_prefixes(spark):
    """Round 3 of near-dedup: families of near misses around one text, each link found among the prefixes' keys."""
    from vectrail.llm import neardup

    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(40):
        words = list(base)
        for at in rng.choice(len(words), size=k % 5, replace=False):
            words[at] = f"x{k}_{at}"
        texts.append(" ".join(words[: 120 - 3 * (k % 4)]))
    docs = spark.createDataFrame([*enumerate(texts), (40, "a b"), (41, "a b c d e")], "doc_id long, text string")
    members = docs.selectExpr("doc_id rep", "doc_id label")
    by_rep = docs.withColumnRenamed("doc_id", "rep")
    rows = neardup.prefixes(members, by_rep).collect()
    keys: dict[int, dict] = {}
    for r in rows:
        keys.setdefault(r["rep"], {})[r["key"]] = (r["size"], r["left"])
    sets = [set(neardup._shingler.shingles(t).tolist()) for t in texts]
    links = 0
    for i in range(40):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links += 1
                met = keys[i].keys() & keys[j].keys()
                assert any(min(keys[i][g][1], keys[j][g][1]) * 175 >= (keys[i][g][0] + keys[j][g][0]) * 75 for g in met)
    assert 0 < links < 780
    assert neardup.prefixes(members.limit(0), by_rep).count() == 0
