"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is
parsed from left to right into the longest phrases that occur in the labelled
text: following the automaton from its root, a missing transition ends a
phrase, and a character that the labelled text lacks is a phrase of its own.
The number of phrases times the logarithm of the labelled text's length is the
cross-entropy estimate of the text, so languages with little labelled text are
on a par. The language that needs least wins; the score is how far the second
falls behind.

Labelled text is a bounded sample of rows: of each language, in the order of a
hash, whole texts of at most ``LONGEST`` characters until they have
``SAMPLE_CHARS``, from ``SAMPLE_DOCS`` rows at most; where all are longer, the
shortest one. These strings, one for each language, reach the driver and are
broadcast; workers build the automata once. Every letter of them has a code of
its own; tables of transitions that would get large are hash tables, so memory
grows with the samples only.

Whole texts are parsed. numpy advances strips of ``STRIP`` characters of all
texts together, each from the automaton's root; then each strip is parsed again
from the state in which the strip before it ended, until both parses meet,
which gives exactly the phrases of the whole text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
without labelled text every row is ``und``; ties go to the language with more
labelled documents in the sample, then to the smaller name; an empty table
gives an empty result; repeated rows each get the same result; very long texts
take time in proportion to their length; extra columns are read only to be
kept, and columns of results get other names by ``names`` where they clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, map_arrow, table

SAMPLE_DOCS = 256
SAMPLE_CHARS = 40_000
LONGEST = 8_000
STRIP = 256
#: Largest table of transitions of one language, in bytes; larger ones are hashed.
DENSE = 16 << 20
UNDETERMINED = "und"
#: Codes of characters: none (ends a strip), a letter of no sample, a gap between words; letters follow.
PAD, OTHER, GAP, FIRST = 0, 1, 2, 3


class SuffixAutomaton:
    """All substrings of a sequence of codes, as transitions from state 0."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Transitions:
    """A suffix automaton's edges for many states at once: a table where it takes at most ``DENSE`` bytes, else a hash table, with the same results."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, automaton: SuffixAutomaton, alphabet: int):
        self.alphabet = alphabet
        edges = [(s * alphabet + c, t) for s, out in enumerate(automaton.next) for c, t in out.items()]
        self.edge_keys = np.array([k for k, _ in edges], dtype=np.int64)
        self.edge_to = np.array([t for _, t in edges], dtype=np.int32)
        self.scalar: dict[int, int] | None = None
        self.root = np.zeros(alphabet, dtype=np.int32)
        for c, t in automaton.next[0].items():
            self.root[c] = t
        #: what a code without an edge leads to: 4 * the state + phrases, where the code is absent one of its own
        self.after = np.where(self.root > 0, self.root * 4, 1).astype(np.int32)
        # codes of this language alone, those that it lacks being one
        own = np.flatnonzero(self.root)
        self.local = np.ones(alphabet, dtype=np.int32)
        self.local[PAD], self.local[own] = 0, np.arange(2, 2 + len(own))
        self.width = 2 + len(own)
        n_states = len(automaton.next)
        self.table = None
        if 4 * n_states * self.width <= DENSE:
            first = np.append([0, 1], self.after[own]).astype(np.int32)
            table = np.tile(first + 1, (n_states, 1))
            table[0] = first
            table[self.edge_keys // alphabet, self.local[self.edge_keys % alphabet]] = 4 * self.edge_to
            table[:, 0] = 4 * np.arange(n_states)
            self.table = table.ravel()
        else:
            self.hash_edges()

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def hash_edges(self) -> None:
        bits = max(4, int(2 * len(self.edge_keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        todo, at = np.arange(len(self.edge_keys)), self.place(self.edge_keys)
        while len(todo):  # a key whose place is taken tries the next one
            free = np.flatnonzero(self.keys[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.to[at[won]] = self.edge_keys[todo[won]], self.edge_to[todo[won]]
            left = np.ones(len(todo), dtype=bool)
            left[won] = False
            todo, at = todo[left], (at[left] + 1) & self.mask

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """Codes as ``step`` takes them."""
        return self.local[columns] if self.table is not None else columns

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """4 * the states after one code each + how many phrases ended: the one before the code, and the code itself if it is absent."""
        if self.table is not None:
            return np.take(self.table, state * self.width + code)
        key = state * np.int64(self.alphabet) + code
        at = self.place(key)
        found = self.keys[at]
        to = np.where(found == key, self.to[at], np.int32(-1))
        going = np.flatnonzero((found != key) & (found >= 0))
        while len(going):
            at[going] = (at[going] + 1) & self.mask
            found = self.keys[at[going]]
            hit = found == key[going]
            to[going[hit]] = self.to[at[going[hit]]]
            going = going[~hit & (found >= 0)]
        return np.where(code == PAD, state * 4, np.where(to >= 0, to * 4, self.after[code] + (state > 0)))

    def one_strip(self, state: int, column: np.ndarray, met: np.ndarray) -> tuple[int, int, int]:
        """Where one strip's parse from ``state`` meets the states ``met`` (STRIP if nowhere), with its state and phrases there."""
        if self.scalar is None:
            self.scalar = dict(zip(self.edge_keys.tolist(), self.edge_to.tolist(), strict=True))
        count, alphabet, edges = 0, self.alphabet, self.scalar
        for i, (code, there) in enumerate(zip(column.tolist(), met.tolist(), strict=False)):
            if there == state:
                return i, state, count
            if code != PAD:
                to = edges.get(state * alphabet + code, -1)
                if to < 0:
                    after = int(self.after[code])
                    count += (after & 3) + (state > 0)
                    to = after >> 2
                state = to
        return STRIP, state, count

    def phrases(self, columns: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases of each strip (columns[i] has the i-th code of all); ``follows`` tells strips that go on from the one before.

        A phrase counts where it ends, and at the end of a text.
        """
        n = columns.shape[1]
        codes = self.codes(columns)
        states = np.zeros((STRIP + 1, n), dtype=np.int32)
        counts = np.zeros((STRIP + 1, n), dtype=np.int32)
        for i in range(STRIP):
            packed = self.step(states[i], codes[i])
            np.right_shift(packed, 2, out=states[i + 1])
            np.add(counts[i], packed & 3, out=counts[i + 1])
        total, out = counts[-1].copy(), states[-1].copy()
        # strips that go on: parse again from the state before, up to where both parses are in one state
        lane = np.flatnonzero(follows)
        state, count = out[lane - 1], np.zeros(len(lane), dtype=np.int32)
        came = np.zeros(n, dtype=np.int32)
        came[lane] = state
        for i in range(STRIP):
            met = states[i, lane] == state
            if met.any():
                total[lane[met]] += count[met] - counts[i, lane[met]]
                lane, state, count = lane[~met], state[~met], count[~met]
            if not len(lane):
                break
            packed = self.step(state, codes[i, lane])
            state, count = packed >> 2, count + (packed & 3)
        total[lane], out[lane] = count, state
        # few strips never meet; the ones after them go again, one by one, as long as the state that they start from is another
        for k in (np.flatnonzero(follows & (np.append(0, out[:-1]) != came))).tolist():
            while k < n and follows[k] and out[k - 1] != came[k]:
                came[k] = out[k - 1]
                i, end, more = self.one_strip(int(came[k]), columns[:, k], states[:-1, k])
                total[k] = more + counts[-1, k] - counts[i, k] if i < STRIP else more
                out[k] = states[-1, k] if i < STRIP else end
                k += 1
        last = ~np.append(follows[1:], False)
        return total + (last & (out > 0))


class CrossParser:
    def __init__(self, samples: dict[str, str], weights: dict[str, int]):
        self.languages = sorted(samples, key=lambda x: (-weights[x], x))
        known = sorted({ch for t in samples.values() for ch in t.lower() if ch.isalpha()})
        self.code = np.full(0x110000, GAP, dtype=np.int32)
        self.code[[at for at in range(0x110000) if chr(at).isalpha()]] = OTHER
        self.code[[ord(ch) for ch in known]] = np.arange(FIRST, FIRST + len(known))
        self.alphabet = FIRST + len(known)
        coded = [self.encode(samples[x]).tolist() for x in self.languages]
        self.tables = [Transitions(SuffixAutomaton(c), self.alphabet) for c in coded]
        #: bits to point at a phrase of each labelled text
        self.bits = np.log2([len(c) + 2 for c in coded])

    def encode(self, text: str) -> np.ndarray:
        """Codes of the lower-cased text with runs of gaps as one."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.code[points]
        gap = codes == GAP
        return codes[~(gap & np.append(True, gap[:-1]))] if len(codes) else codes

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """(language, text): the number of phrases."""
        strips = np.array([max(1, -(-len(c) // STRIP)) for c in coded])
        owner = np.repeat(np.arange(len(coded)), strips)
        grid = np.zeros(len(owner) * STRIP, dtype=np.int32)
        for c, at in zip(coded, (np.cumsum(strips) - strips) * STRIP, strict=True):
            grid[at : at + len(c)] = c
        columns = np.ascontiguousarray(grid.reshape(-1, STRIP).T)
        follows = np.append(False, owner[1:] == owner[:-1])
        return np.array([np.bincount(owner, t.phrases(columns, follows), minlength=len(coded)) for t in self.tables])

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        coded = [self.encode(t) for t in texts]
        need = np.zeros((len(self.languages), len(texts)))
        at = 0
        while at < len(texts):  # texts together, as long as they have few strips
            end, chars = at, 0
            while end < len(texts) and (end == at or chars < 1 << 20):
                chars += len(coded[end]) + STRIP
                end += 1
            need[:, at:end] = self.phrases(coded[at:end]) * self.bits[:, None]
            at = end
        has_letter = np.array([bool((c != GAP).any()) for c in coded], dtype=bool)
        rank = np.argsort(need, axis=0, kind="stable")
        best = need[rank[0], np.arange(len(texts))]
        second = need[rank[1], np.arange(len(texts))] if len(self.languages) > 1 else best * 2
        score = np.where(second > 0, 1 - best / np.maximum(second, 1e-9), 0.0)
        names = [self.languages[k] if ok else UNDETERMINED for k, ok in zip(rank[0], has_letter, strict=True)]
        return names, np.where(has_letter, np.clip(score, 0, 1), 0.0).tolist()


_parsers: dict[str, CrossParser] = {}


def parser_of(samples: dict[str, str], weights: dict[str, int]) -> CrossParser:
    key = hashlib.sha256(repr((sorted(samples.items()), sorted(weights.items()))).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(samples, weights)
    return _parsers[key]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, longest: int = LONGEST) -> tuple[dict[str, str], dict[str, int]]:
    """Labelled text of each language, and how many documents it is from: whole texts of at most ``sample_docs`` rows a language, as many as have ``sample_chars``, reach the driver."""
    length = F.length("text")
    long = length > longest
    order = Window.partitionBy("lang").orderBy(long, F.when(long, length), F.xxhash64("doc_id", "text"), "doc_id", "text")
    ranked = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text", F.row_number().over(order).alias("r")).filter(F.col("r") <= sample_docs)
    # at most sample_docs rows a language are left; of these, the first that have the characters
    before = F.sum(length).over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    rows = ranked.withColumn("before", F.coalesce(before, F.lit(0))).filter((F.col("before") < sample_chars) & (~long | (F.col("r") == 1))).select("lang", "r", "text").collect()
    samples: dict[str, list[str]] = {}
    for x in sorted(rows, key=lambda x: (x["lang"], x["r"])):
        samples.setdefault(x["lang"], []).append(x["text"])
    return {k: " ".join(v) for k, v in samples.items()}, {k: len(v) for k, v in samples.items()}


def identify(docs: DataFrame, samples: dict[str, str], weights: dict[str, int], keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of docs, with the predicted language and its score from the text under ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast((samples, weights))
    kinds = T.StructType([*docs.select(*keep).schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    extra = [] if "text" in keep else ["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language", _parsers.clear)
        learned, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = [t or "" for t in part.column("text").to_pylist()]
                if learned:
                    found, scores = parser_of(learned, counts).predict(texts)
                else:
                    found, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*keep, *names])

    return map_arrow(docs.select(*keep, *extra), run, kinds)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples, weights = learn_samples(docs)
    return identify(docs.withColumn("held_out", held_out()), samples, weights, ["doc_id", "held_out"])
