"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct 5-word shingles (A-Z lowered). Its sketch has
``M`` registers: each holds the smallest of the set's exponential values for
it, truncated to a power of ``BASE``. Sketches of parts merge by maximum, and
two registers agree about as often as the sets' Jaccard similarity.

1. Rows with equal sets become one class (a 128-bit digest of the whole set).
2. ``BANDS`` bands of ``ROWS`` registers give bucket keys. A pair at similarity
   0.75 shares no bucket with probability (1 - 0.75**5)**51, about 1e-6.
3. Candidates are estimated jointly by likelihood from how many registers are
   greater, less or equal; those below ``FLOOR`` (over five standard
   deviations under the threshold) go.
4. The rest is confirmed on the full sets, and links become components.

Buckets are never expanded into all pairs. Round 1 compares each member with
its bucket's first class, and round 2 with its bucket's class of most links.
Round 3 takes the members of buckets that are then still in several components
and pairs them, across components, where their rarest shingles meet. Prefix and
position filters are exact for every linked pair; a member that even the
smallest set of its key can't be linked with goes before pairing, sizes are
joined in ranges that linked sets can have, and keys of very many members are
dealt out by a hash. Pairs inside one component need no comparison, so after
round 3 every candidate link is decided.

A document is a doc_id. Classes are told apart by their smallest doc_id, or by
a hash where that has several texts or is null.

Defined results: a null text, or one without words, has size 0 and is linked
with nothing; fewer than 5 words are one shingle; rows that share a doc_id are
one document, so their texts are linked, and each row has its own size; rows
with a null doc_id are linked like others, with component_id null where no
doc_id is reachable, and are never ``kept`` (``keep_one`` keeps one of those,
too); repeated rows get the same result; very long texts are read whole; an
empty table gives an empty result; extra columns are not read by
``near_duplicates`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import claim, free_names, give_back, map_arrow, small, stage_table, table

WORDS = 5
PERCENT = 75
M, BANDS, ROWS = 257, 51, 5
BASE, RATE = 1.02, 20.0
FLOOR = 0.6
#: Links a class confirms in round 1; the best by estimate.
BEST = 2
MEMORY = 250_000
#: Fewest and most counters of the order of shingles in round 3, by how many shingles there are; they reach the driver.
SLOTS, MOST_SLOTS = 1 << 18, 1 << 20
#: Members of a key of round 3 that are paired in one task.
HOT = 4096

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > MEMORY:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w, 20)
        return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = self.word_hashes(words)
        n = min(WORDS, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
        return np.unique(mix(out))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers for each set.

    The j-th value of an element lies in the j-th of M slices of the
    exponential distribution and falls to the j-th register of a permutation
    of its own, so values come in rising order and stop to matter once a
    set's every register is lower. ``t`` is exp(-RATE * value).
    """
    sizes = np.array([len(s) for s in sets])
    best = np.zeros((len(sets), M))
    flat = best.ravel()
    element = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    place = (element % _U(M)).astype(np.int64)
    stride = (mix(element + _U(0x632BE59BD9B4E019)) % _U(M - 1)).astype(np.int64) + 1
    for j in range(M):
        if not len(element):
            break
        u = (mix(element + _U((j * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(np.float64) * 2.0**-53
        np.maximum.at(flat, owner * M + place, (M - j - u) / M)
        if j % 2 or j < 2:
            more = best.min(axis=1) < (M - j - 1) / M
            live = more[owner]
            if not live.all():
                element, owner, place, stride = element[live], owner[live], place[live], stride[live]
        place = (place + stride) % M
    with np.errstate(divide="ignore"):
        value = -np.log(best) / RATE
    registers = np.floor(1 - np.log(np.maximum(value, 1e-300)) / math.log(BASE))
    return np.where(best > 0, np.clip(registers, 1, 65534), 0).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of largest likelihood for pairs of sketches of sets with known sizes."""
    greater, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - greater - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 65)[None, :] * most[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    like = greater[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return grid[np.arange(len(grid)), like.argmax(axis=1)]


_shingler = Shingler()
SKETCHED = "doc_id long, th long, n_shingles long, h1 long, h2 long, sketch binary"


def key_of_text() -> tuple[Column, Column]:
    """doc_id and th, a text of a document."""
    return F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th")


def sketch_documents(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _shingler.seen.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [_shingler.shingles(t) for t in part.column("text").to_pylist()]
                rows = sketches(sets)
                h1 = [int(mix(s).sum(dtype=np.uint64)) for s in sets]
                h2 = [int(mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64)) for s in sets]
                signed = lambda xs: pa.array(np.array(xs, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([len(s) for s in sets], pa.int64()), signed(h1), signed(h2), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "th", "n_shingles", "h1", "h2", "sketch"])
        give_back()

    return map_arrow(docs.select(*key_of_text(), "text"), run, SKETCHED)


def registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, M)


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, rep), one row for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _shingler.seen.clear)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = registers(batch.column("sketch"))[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + _U(1), s.shape[:2])
            for k in range(ROWS):
                key = mix(key * _U(0x9E3779B97F4A7C15) + s[:, :, k])
            rep = np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(rep)], ["key", "rep"])

    return map_arrow(reps.select("rep", "sketch"), run, "key long, rep long")


def with_estimates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) with their estimated similarity, those under FLOOR left out."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _shingler.seen.clear)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                j = estimate(registers(part.column("sa")), registers(part.column("sb")), part.column("na").to_numpy().astype(float), part.column("nb").to_numpy().astype(float))
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(j)], ["a", "b", "j"])
                yield out.filter(pa.array(j >= FLOOR))

    # sizes alone rule out a pair whose smaller set is under 75 % of the larger
    near = (F.col("na") * 100 >= F.col("nb") * PERCENT) & (F.col("nb") * 100 >= F.col("na") * PERCENT)
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").filter(near).select("a", "b", "sa", "sb", "na", "nb"), run, "a long, b long, j double")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are linked."""
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"t{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _shingler.seen.clear)
        for batch in batches:
            linked = []
            last, set_b = None, None
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                if tb != last:
                    last, set_b = tb, _shingler.shingles(tb)
                set_a = _shingler.shingles(ta)
                both = len(np.intersect1d(set_a, set_b, assume_unique=True))
                linked.append(100 * both >= PERCENT * (len(set_a) + len(set_b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(linked, pa.bool_()))
        give_back()

    return map_arrow(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb"), run, "a long, b long")


def prefixes(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, rep, label, size, left): the shingles among which a set shares its first one with any set that it is linked to.

    Under one order of all shingles, two linked sets share an element before
    each has fewer than PERCENT of its own left; ``left`` counts from the
    element on. Any order gives whole results. This one puts shingles of rarer
    hash slots first, so that what many texts share is seldom among the keys.
    """
    sets = stage_table(members.join(texts, "rep").select("rep", "label", "text"), "sets")

    words = sets.agg(F.sum(F.length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(SLOTS, 1 << int(words // 2).bit_length()))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _shingler.seen.clear)
        count = np.zeros(slots, dtype=np.int64)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                count[(_shingler.shingles(t) % _U(slots)).astype(np.int64)] += 1  # once a text, so that a slot of one text counts 1
        slot = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count[slot])], ["slot", "n"])

    told = map_arrow(sets.select("text"), tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(slots, dtype=np.int32)
    frequency[told.column("slot").to_numpy()] = np.minimum(told.column("n").to_numpy(), 2**31 - 1)
    shared = sets.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _shingler.seen.clear)
        for batch in batches:
            keys, sizes, left = [np.empty(0, dtype=np.uint64)], [], [np.empty(0, dtype=np.int64)]
            for t in batch.column("text").to_pylist():
                s = _shingler.shingles(t)
                often = shared.value[(s % _U(slots)).astype(np.int64)]
                first = np.argsort(often, kind="stable")[: len(s) + (-len(s) * PERCENT) // 100 + 1]
                met = np.flatnonzero(often[first] > 1)  # a slot's only shingle is in no other set
                keys.append(s[first[met]])
                left.append(len(s) - met)
                sizes.append((len(met), len(s)))
            n, size = np.array(sizes, dtype=np.int64).reshape(-1, 2).T
            of = lambda c, n=n, batch=batch: np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(of("rep")), pa.array(of("label")), pa.array(np.repeat(size, n)), pa.array(np.concatenate(left))], ["key", "rep", "label", "size", "left"])

    return stage_table(map_arrow(sets, run, "key long, rep long, label long, size long, left long"), "prefixes")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b) reaches.

    Each turn hooks nodes to their smallest neighbour, jumps along these
    hooks, and contracts the edges; turns go as the logarithm of the size.
    """
    edges = stage_table(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage_table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")), "hook")
        for _ in range(2):
            up = hook.select(F.col("node").alias("to"), F.col("to").alias("up"))
            hook = stage_table(hook.join(up, "to").select("node", F.col("up").alias("to")), "hook")
        if mapping is None:
            mapping = hook.select("node", F.col("to").alias("label"))
        else:
            mapping = stage_table(mapping.join(hook.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        to = lambda x, h=hook: h.select(F.col("node").alias(x), F.col("to").alias(f"{x}2"))
        edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        edges = stage_table(edges.filter("a <> b").distinct(), "edges")
    return mapping if mapping is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def ordered(a: str, b: str, *more) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *more]


def pairs_of_keys(apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels among the prefixes ``apart`` that the position filter leaves.

    Every pair has a side that isn't of its key's commonest label, so a large component isn't paired with itself.
    """
    size, left = F.col("size"), F.col("left")
    # a member goes if even the smallest set of its key is too large for what it has left
    smallest = apart.groupBy("key").agg(F.min("size").alias("least"))
    apart = apart.join(smallest, "key").filter(left * (100 + PERCENT) >= (size + F.col("least")) * PERCENT).drop("least")
    shared = apart.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    apart = stage_table(apart.join(shared, "key"), "apart")
    counts = apart.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("major"), F.ceil(F.sum("n") / HOT).alias("parts"))
    # linked sets lie in one range of sizes or in neighbouring ones, as ranges grow by more than 100 / PERCENT
    span = F.floor(F.log(size) / F.lit(math.log(100 / PERCENT) + 1e-9))
    apart = stage_table(apart.join(keys, "key").withColumn("is_major", F.col("label") == F.col("major")).withColumn("span", span).drop("major"), "apart")
    # a key of many members: each outside member goes to one part, all others to each
    dealt = apart.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    outside = apart.filter(~F.col("is_major")).select("key", F.explode(F.array(*(F.col("span") + d for d in (-1, 0, 1)))).alias("span"), F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), F.col("rep").alias("x"), F.col("label").alias("lx"), F.col("size").alias("nx"), F.col("left").alias("left_x"))
    enough = F.least("left", "left_x") * (100 + PERCENT) >= (F.col("size") + F.col("nx")) * PERCENT
    met = dealt.join(outside, ["key", "span", "part"]).filter((F.col("label") != F.col("lx")) & enough & (F.col("is_major") | (F.col("rep") < F.col("x"))))
    return met.select(*ordered("rep", "x")).distinct()


def links(docs: DataFrame, reps: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links between classes that, with the ``known`` ones, suffice for the components, and the components. ``reps`` has the key of one text of each class."""
    keys = stage_table(band_keys(reps), "bands")
    order = F.struct(F.xxhash64("rep").alias("h"), "rep")
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order)["rep"].alias("center")).filter("n > 1")
    members = stage_table(keys.join(full.select("key", "center"), "key"), "members")
    one = reps.join(members.select("rep").distinct(), "rep", "left_semi").select(F.xxhash64("doc_id", "th").alias("k"), "rep", F.struct("doc_id", "th").alias("c"))
    keyed = docs.select(*key_of_text(), "text").withColumn("k", F.xxhash64("doc_id", "th"))
    texts = keyed.join(small(stage_table(one, "wanted")), "k").filter(F.struct("doc_id", "th").eqNullSafe(F.col("c"))).select("k", "rep", "text")
    texts = stage_table(texts.dropDuplicates(["k", "rep"]).drop("k"), "texts")

    # round 1: the bucket's first class
    pairs = members.filter("rep <> center").select(*ordered("rep", "center")).distinct()
    guess = stage_table(with_estimates(pairs, reps), "estimates")
    later = Window.partitionBy("b").orderBy(F.desc("j"), "a")
    best = guess.withColumn("r", F.row_number().over(later)).filter(F.col("r") <= BEST)
    found = stage_table(confirm(best, texts).unionByName(known), "links")
    label = stage_table(components(found), "labels")

    def labelled(found: DataFrame, label: DataFrame) -> DataFrame:
        ends = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("degree"))
        of = label.withColumnRenamed("node", "rep").join(ends, "rep", "left")
        return stage_table(members.select("key", "rep").join(of, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree")), "labelled")

    # round 2: the bucket's class of most links
    rows = labelled(found, label)
    top = F.max(F.struct("degree", F.xxhash64("rep").alias("h"), F.col("rep").alias("center"), F.col("label").alias("c_label")))
    active = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), top.alias("t")).filter("lo <> hi").select("key", "t.center", "t.c_label")
    pairs = rows.join(active, "key").filter("label <> c_label").select(*ordered("rep", "center")).distinct()
    more = stage_table(confirm(with_estimates(pairs, reps), texts), "links")
    found = found.unionByName(more)
    label = stage_table(components(found), "labels")

    # round 3: all that is still apart, by shingles that linked sets must share among their rarest
    rows = labelled(found, label)
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    apart = prefixes(rows.join(mixed, "key").select("rep", "label").distinct(), texts)
    more = stage_table(confirm(with_estimates(pairs_of_keys(apart), reps), texts), "links")
    found = found.unionByName(more)
    return found, stage_table(components(found), "labels")


DIGEST = ("n_shingles", "h1", "h2")


def resolve(docs: DataFrame) -> DataFrame:
    """Of each row: doc_id, th, n_shingles, component_id, and ``keeper`` (doc_id, th), the text of its component that stands for all; null where the set is empty."""
    sketched = stage_table(sketch_documents(docs), "sketches")
    some = sketched.filter("n_shingles > 0")
    # one text of each class: the smallest doc_id, nulls last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th"))
    classes = stage_table(some.groupBy(*DIGEST).agg(first.alias("k")).select(*DIGEST, "k.none", "k.doc_id", "k.th"), "classes")
    # classes of one smallest doc_id: the first has it as its number
    shared = classes.filter("not none").groupBy("doc_id").agg(F.min(F.struct(*DIGEST)).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("id"), "f")
    other = F.col("none") | (F.col("f").isNotNull() & (F.col("f") != F.struct(*DIGEST)))
    number = F.when(other, F.xxhash64(F.lit("class"), *DIGEST)).otherwise(F.col("doc_id"))
    classes = stage_table(classes.join(shared, F.col("doc_id") == F.col("id"), "left").select(number.alias("rep"), *DIGEST, "none", "doc_id", "th"), "classes")
    # joined by one hash, so that the exchange serves the join and the removal of repeated rows
    keyed = some.withColumn("k", F.xxhash64("doc_id", "th", *DIGEST))
    one = classes.select(F.xxhash64("doc_id", "th", *DIGEST).alias("k"), "rep", F.struct("doc_id", "th").alias("c"))
    reps = keyed.join(one, "k").filter(F.struct("doc_id", "th").eqNullSafe(F.col("c"))).select("k", "rep", "doc_id", "th", "n_shingles", "sketch")
    reps = stage_table(reps.dropDuplicates(["k", "rep"]).drop("k"), "reps")
    # texts of one doc_id are linked
    several = some.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*DIGEST)).alias("lo"), F.max(F.struct(*DIGEST)).alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    rep_of = lambda at, name: classes.select(F.struct(*DIGEST).alias(at), F.col("rep").alias(name))
    known = stage_table(some.join(several, "doc_id").select("lo", F.struct(*DIGEST).alias("own")).distinct().join(rep_of("lo", "x"), "lo").join(rep_of("own", "y"), "own").filter("x <> y").select(*ordered("x", "y")), "known")
    _, label = links(docs, reps, known)
    classes = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    classes = stage_table(classes, "labelled")
    keeper = classes.groupBy("label").agg(F.min(F.struct("none", "doc_id", "th")).alias("k")).select("label", F.struct("k.doc_id", "k.th").alias("keeper"))
    of = classes.select(*DIGEST, "label").join(keeper, "label").select(*DIGEST, "keeper")
    rows = sketched.select("doc_id", "th", *DIGEST).join(of, [*DIGEST], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("keeper.doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "th", "n_shingles", component.alias("component_id"), "keeper")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return resolve(docs).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component; rows without words stay."""
    rows = resolve(docs).filter("n_shingles > 0")
    stands = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("th") == F.col("keeper.th"))
    keys = stage_table(rows.groupBy("doc_id", "th", stands.alias("stands")).agg(F.count(F.lit(1)).alias("n")), "kept")
    # texts meet all keys that go, or stay once, in one join
    drop, again = keys.filter("not stands or n > 1"), keys.filter("stands and n > 1")
    own, hashed = free_names(docs.columns, "own", "hashed")
    keyed = docs.withColumns(dict(zip((own, hashed), key_of_text(), strict=True)))
    is_in = lambda k: keyed[own].eqNullSafe(k["doc_id"]) & (keyed[hashed] == k["th"])
    drop, again = small(drop), small(again)
    left = keyed.join(drop, is_in(drop), "left_anti")
    # of equal texts of one doc_id one row stays
    once = left.unionByName(keyed.join(again, is_in(again), "left_semi").dropDuplicates([own, hashed]))
    return once.select(*docs.columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
