"""Packing token sequences by the sum-of-squares rule.

Each document becomes its token ids and an end id. A document longer than the
capacity is cut into full pieces and a last shorter one; all others stay whole.
A piece goes to the open bin, or to a new one, whose choice makes the sum over
gaps g of (number of open bins with gap g) squared smallest; ties take the
tightest gap, and within a gap the bin opened first.

Pieces are dealt to groups of about ``GROUP`` by a hash, and each group is
packed longest first as one task. The pieces of a group's emptiest bins (at
most ``PASS_ON`` bins) then meet those of other groups in a tree of fan-in
``FAN_IN``, so that half-filled sequences don't add up with the number of
groups. Every bin that isn't passed on is final, so no piece is ever dropped.

Defined results: a null text is empty and is one piece that holds the end id;
an empty table gives an empty result; repeated rows are packed as rows of
their own and dealt to different groups; very long texts are cut into pieces of
the capacity; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, give_back, map_arrow, stage_table, table
from .tokens import PLAIN, vocabulary_path

CAPACITY = 4096
END_ID = 1
GROUP = 16384
FAN_IN = 16
PASS_ON = 48
#: Remembered parts of text in a worker, and the longest of them in bytes.
MEMORY, LONGEST = 400_000, 48
#: Bytes of text that are encoded together, unless a single word has more.
BLOCK = 1 << 20

#: Kinds of UTF-8 bytes: between words; in runs of letters, single digits and runs of other signs; in words that stay whole.
GAP, LETTER, DIGIT, SIGN, OTHER = range(5)
GAPS = (b" ", b"\n")
#: The first byte of the two of a character from U+00C0 to U+00FF; the second is less by 64 than the character.
LATIN = 0xC3
KINDS = np.full(256, OTHER, dtype=np.uint8)
for _c in range(128):
    if PLAIN.fullmatch(chr(_c)):
        KINDS[_c] = LETTER if chr(_c).isalpha() else DIGIT if chr(_c).isdigit() else SIGN
KINDS[[ord(_g) for _g in GAPS]] = GAP
KINDS[LATIN] = KINDS[0x80:0xC0] = LETTER
#: Pairs of bytes that keep a word whole, though each byte alone doesn't.
ODD_PAIRS = [b"<|", *(chr(_c).encode() for _c in range(0xC0, 0x100) if not PLAIN.fullmatch(chr(_c)))]
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


class Encoder:
    """Token ids as little-endian bytes.

    A text is cut into words at spaces and line feeds, which no token crosses, and a word of only ``PLAIN`` characters
    into runs in lower case, each one pre-token; other words stay whole. Each different part of a block is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, normal, pre = self.library.model, self.library.normalizer, self.library.pre_tokenizer
        #: How the model spells each character of a run, by the vocabulary's own rules.
        self.spelt = {c: "".join(w for w, _ in pre.pre_tokenize_str(normal.normalize_str(chr(c)) if normal else chr(c))) for c in range(256) if PLAIN.fullmatch(chr(c))}
        #: Whether runs in lower case have the same tokens.
        self.folds = all(self.spelt[c] == self.spelt[ord(chr(c).lower())] for c in self.spelt)
        self.seen: dict[bytes, bytes] = {}

    def parts(self, block: bytes) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Where the block's parts begin, which of them are runs, and the parts."""
        text = np.frombuffer(block, dtype=np.uint8)
        kind = KINDS[text]
        odd = kind == OTHER
        for pair in ODD_PAIRS:
            if pair in block:
                odd[1:] |= (text[:-1] == pair[0]) & (text[1:] == pair[1])
        if odd.any():
            word = np.cumsum(kind == GAP, dtype=np.int32)
            whole = np.zeros(word[-1] + 1, dtype=bool)
            whole[word[odd]] = True
            kind[whole[word] & (kind != GAP)] = OTHER
        begins = kind != GAP
        used = begins.copy()
        begins[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero(begins)
        if self.folds:
            text = np.where(kind == OTHER, text, LOWER[text])
            second = np.flatnonzero(text[:-1] == LATIN) + 1
            second = second[(kind[second] != OTHER) & (text[second] < 0x9F)]
            text[second] += 32
        offsets = np.append(np.flatnonzero(begins[used]), np.count_nonzero(used))
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(text[used])])
        return at, kind[at] != OTHER, parts.dictionary_encode()

    def learn_runs(self, runs: list[bytes]) -> None:
        """Remember the ids of parts that are one pre-token each."""
        model, spelt = self.model.tokenize, self.spelt
        found = [[t.id for t in model(r.decode().translate(spelt))] for r in runs]
        ends = [0, *accumulate(4 * len(f) for f in found)]
        data = np.fromiter(chain.from_iterable(found), dtype="<u4", count=ends[-1] // 4).tobytes()
        self.seen.update((r, data[a:b]) for r, a, b in zip(runs, ends[:-1], ends[1:], strict=True))

    def learn_joined(self, words: list[str]) -> None:
        """Encode words without inner white space as one text; offsets tell whose each id is."""
        e = self.library.encode(" ".join(words), add_special_tokens=False)
        ids, starts = np.array(e.ids, dtype="<u4"), np.array([a for a, _ in e.offsets], dtype=np.int64)
        ends = np.cumsum([len(w) + 1 for w in words])
        bounds = np.append(0, np.searchsorted(starts, ends, side="left"))
        for w, a, b in zip(words, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            self.seen[w.encode()] = ids[a:b].tobytes()

    def learn_words(self, words: list[str]) -> None:
        """Remember the ids of words that stay whole."""
        joined = [w for w in words if "<|" not in w and len(w.split()) == 1]
        for i in range(0, len(joined), 512):
            self.learn_joined(joined[i : i + 512])
        for w in words:
            if (key := w.encode()) not in self.seen:
                self.seen[key] = np.array(self.library.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_block(self, block: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block that ends in a gap, and how many of them come before each cut."""
        begin, run, coded = self.parts(block)
        parts, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        whole = np.zeros(len(parts), dtype=bool)
        whole[at[~run]] = True
        new = [(p, w) for p, w in zip(parts, whole.tolist(), strict=True) if p not in self.seen]
        self.learn_runs([p for p, w in new if not w])
        self.learn_words([p.decode() for p, w in new if w])
        found = list(map(self.seen.__getitem__, parts))
        for p, _ in new:
            if len(p) > LONGEST:
                del self.seen[p]
        if len(self.seen) > MEMORY:
            self.seen = {}
        of_part, size = np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first, sizes = np.cumsum(size) - size, size[at]
        ends = np.append(0, np.cumsum(sizes))
        ids = of_part[np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], sizes)]
        return ids, ends[np.searchsorted(begin, cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        data = [t.encode() for t in texts]
        ends = np.cumsum([len(d) + 1 for d in data])
        data = b"\n".join([*data, b""])
        ids, bounds, at, n = [], [np.zeros(1, dtype=np.int64)], 0, 0
        while at < len(data):
            # to the last gap of the next BLOCK bytes, or the first one after them
            to = 1 + (max(data.rfind(g, at, at + BLOCK) for g in GAPS) if at + BLOCK < len(data) else len(data) - 1)
            if not to:
                to = 1 + min(g for g in (data.find(g, at + BLOCK) for g in GAPS) if g >= 0)
            inside = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, to, side="right")]
            some, cuts = self.encode_block(data[at:to], inside - at)
            ids.append(some)
            bounds.append(n + cuts)
            at, n = to, n + len(some)
        ids, bounds = np.concatenate([*ids, np.empty(0, dtype="<u4")]), np.concatenate(bounds).tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, as PIECES."""
    path = vocabulary or vocabulary_path()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _encoders.clear)
        enc = encoder(path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = []
            for doc, data in zip(ids, enc.encode(texts), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return map_arrow(docs.select("doc_id", "text"), run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each length, in the given order, and the final gap of each bin."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    worst = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # change of the sum: bin with gap g moves to gap g - size; only gaps above 0 count as open
        have = count[size:]
        change = 2 * (count[: capacity + 1 - size] - have + 1)
        change[0] = 1 - 2 * have[0]
        change = np.where(have > 0, change, worst)
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        at = int(change.argmin())
        if change[at] <= fresh:
            gap = at + size
            b = open_bins[gap].pop(0)
            count[gap] -= 1
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap - size
        if gap > size:
            count[gap - size] += 1
            open_bins[gap - size].append(b)
    return bins, offsets, gaps


def packer(capacity: int, first_id: int, last: bool):
    """One node of the tree: packs a group; ``on`` marks the pieces of bins that go on to the next level."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, gaps = sum_of_squares(rows["length"].to_numpy(), capacity)
        free, on = np.array(gaps), np.zeros(len(gaps), dtype=bool)
        if not last:
            on[np.argsort(-free, kind="stable")[:PASS_ON]] = True
            on &= free > capacity // 64
        # a group has 2**24 ids of its own, above all ids of the levels before
        return rows.assign(sequence_id=first_id + int(rows["g"].iloc[0]) * (1 << 24) + bins, offset=offsets, on=on[bins])

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Places every piece, as PLACED. ``pieces`` should be a written table, as it is read more than once."""
    total = pieces.count()
    groups = max(1, -(-total // group))
    level, base, final = 0, 0, []
    # with the row's place in the table, so that equal rows don't meet in one group
    todo = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    while True:
        last = groups == 1
        placed = stage_table(todo.groupBy("g").applyInPandas(packer(capacity, base, last), f"{PIECES}, g long, sequence_id long, offset long, on boolean"), f"pack{level}")
        final.append(placed.filter(~F.col("on")).drop("g", "on"))
        if last:
            break
        base += groups << 24
        groups = max(1, -(-groups // FAN_IN))
        level += 1
        todo = placed.filter("on").drop("sequence_id", "offset", "on").withColumn("g", F.floor(F.col("g") / FAN_IN).cast("long"))
    out = final[0]
    for f in final[1:]:
        out = out.unionByName(f)
    return out


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    return pack_pieces(stage_table(cut_pieces(docs, vocabulary, capacity), "pieces"), capacity, group)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
