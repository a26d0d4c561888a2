"""Token counts of a byte-pair vocabulary by rank-synchronous array merging.

Pre-tokens are held as one ragged numpy array of symbols. In each step every
sequence finds its lowest-ranked adjacent pair and merges all its occurrences,
left to right, at the same time as all other sequences; a sequence without a
ranked pair is finished and its surviving symbols are its tokens. As a merged
symbol's own pairs always rank after the pair that made it, this gives what
merging one pair after the other gives.

Pre-tokens of more than ``LONG`` characters, such as unbroken runs of letters,
would take a pass over all their symbols for each rank. Their array keeps its
pairs in lists by rank instead; each step takes the list of the lowest rank and
looks again only at pairs next to its merges, so time grows with the length
times its logarithm.

A text is cut at spaces and line feeds, where no pre-token can cross; counts
of the pieces are remembered in a dictionary of bounded size in each Python
worker. Whole texts are counted, whatever their length.

Defined results: a null text is empty and has no tokens; an empty table gives
an empty result; repeated rows each get their count; extra columns are not
read. Special strings inside a text count as the one token that the library
makes of them by default.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import claim, map_arrow, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Pieces remembered in a worker, and the longest of them.
MEMORY = 400_000
LONGEST = 48
#: Pre-tokens longer than this keep their pairs in lists by rank.
LONG = 64

#: Pieces of only these characters can be cut further, into runs that the vocabulary's own rules would part as well: no
#: apostrophe (contractions), no "<|" (special strings), and only letters that normal form and lower case leave single.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")


def runs_of(piece: str) -> list[str] | None:
    """The piece as runs that tokenize alone as they do together; None where that isn't sure."""
    return RUNS.findall(piece) if PLAIN.fullmatch(piece) and "<|" not in piece else None


class RankMerger:
    """Counts the tokens of batches of pieces, as the vocabulary's library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.vocab, self.width = vocab, max(vocab.values()) + 1
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.made_by_rank = made
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.seen: dict[str, int] = {"": 0}

    def pre_tokens(self, piece: str) -> tuple[int, list[str]]:
        """Special strings in the piece, and its pre-tokens."""
        parts = self.special.split(piece) if self.special and "<|" in piece else [piece]
        words: list[str] = []
        for part in parts[::2]:
            if part:
                text = self.normalizer.normalize_str(part) if self.normalizer else part
                words += [w for w, _ in self.pre.pre_tokenize_str(text)]
        return len(parts) // 2, words

    def pre_tokens_of_all(self, pieces: list[str]) -> dict[str, tuple[int, list[str]]]:
        """pre_tokens of many pieces; plain ones go through the library as one text, parted by spaces."""
        plain = [p for p in pieces if "<|" not in p and len(p.split()) == 1]
        out = {}
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            text = self.normalizer.normalize_str(" ".join(part)) if self.normalizer else " ".join(part)
            made = text.split(" ")
            if len(made) != len(part):
                continue
            ends = np.cumsum([len(m) + 1 for m in made])
            words: list[list[str]] = [[] for _ in part]
            found = self.pre.pre_tokenize_str(text)
            home = np.searchsorted(ends, [at[0] for _, at in found], side="right").tolist()
            for k, (w, _) in zip(home, found, strict=True):
                words[k].append(w)
            out.update((p, (0, ws)) for p, ws in zip(part, words, strict=True))
        out.update((p, self.pre_tokens(p)) for p in pieces if p not in out)
        return out

    def merge_counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        counts = np.zeros(len(words), dtype=np.int64)
        long = np.fromiter((len(w) > LONG for w in words), dtype=bool, count=len(words))
        for few, count in ((np.flatnonzero(~long), self.merge_together), (np.flatnonzero(long), self.merge_by_rank)):
            if len(few):
                counts[few] = count([words[i] for i in few])
        return counts

    def ragged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words as one array, and whose each is."""
        vocab, end = self.vocab, self.end
        flat = [x for w in words if w for x in (*(vocab[c] for c in w[:-1]), vocab[w[-1] + end])]
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        return np.array(flat, dtype=np.int64), np.repeat(np.arange(len(words)), lengths)

    def merge_by_rank(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of long pre-tokens: linked positions, and lists of pairs by rank."""
        symbols, owner = self.ragged(words)
        n, none = len(symbols), np.iinfo(np.int64).max
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, none)
        alive = np.ones(n, dtype=bool)
        lists: dict[int, list[np.ndarray]] = {}
        todo: list[int] = []

        def look(at: np.ndarray) -> None:
            """Ranks of the pairs that start at these positions, entered in the lists."""
            second = np.minimum(after[at], n - 1)
            pair = symbols[at] * self.width + symbols[second]
            key = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[key] == pair) & (after[at] < n) & (owner[second] == owner[at])
            rank[at] = np.where(known, self.rank[key], none)
            at = at[known]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            ranks, starts = np.unique(rank[at], return_index=True)
            for r, part in zip(ranks.tolist(), np.split(at, starts[1:]), strict=True) if len(at) else ():
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(todo, r)
                lists[r].append(part)

        look(np.arange(n))
        while todo:
            r = heapq.heappop(todo)
            at = np.unique(np.concatenate(lists.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of overlapping pairs, as in "aaa", the first, third, ... of the run merge
            first = np.append(True, after[at[:-1]] != at[1:])
            index = np.arange(len(at))
            at = at[(index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0]
            gone = after[at]
            alive[gone], rank[gone] = False, none
            symbols[at] = self.made_by_rank[r]
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left = before[at]
            look(np.unique(np.concatenate([at, left[left >= 0]])))
        return np.bincount(owner[alive], minlength=len(words))

    def merge_together(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of short pre-tokens: each step passes over all that are left."""
        counts = np.zeros(len(words), dtype=np.int64)
        symbols, owner = self.ragged(words)
        none = np.iinfo(np.int64).max
        while len(symbols):
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.rank[at], none), none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == none
            counts[owner[starts[done]]] = sizes[done]
            hit = (rank == np.repeat(lowest, sizes)) & (rank != none)
            # of overlapping pairs, as in "aaa", the first, third, ... of the run merge
            index = np.arange(len(hit))
            first = hit & ~np.append(False, hit[:-1])
            hit &= (index - np.maximum.accumulate(np.where(first, index, 0))) % 2 == 0
            symbols = symbols.copy()
            symbols[hit] = self.made[at[np.flatnonzero(hit)]]
            keep = ~np.append(False, hit[:-1]) & ~np.repeat(done, sizes)
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def learn(self, pieces: set[str]) -> None:
        """Remember the counts of new pieces."""
        runs = {p: runs_of(p) or [p] for p in pieces}
        parts = {r for rs in runs.values() for r in rs}.difference(self.seen)
        found = self.pre_tokens_of_all(list(parts))
        new = list({w for _, ws in found.values() for w in ws})
        of_word = dict(zip(new, self.merge_counts(new).tolist(), strict=True)).__getitem__
        self.seen.update((p, n + sum(map(of_word, ws))) for p, (n, ws) in found.items())
        of_part = self.seen.__getitem__
        self.seen.update((p, sum(map(of_part, rs))) for p, rs in runs.items() if len(rs) > 1)

    def forget(self, pieces: set[str]) -> None:
        """Keep the dictionary bounded: long pieces go at once, all the rest when there are too many."""
        for p in pieces:
            if len(p) > LONGEST:
                self.seen.pop(p, None)
        if len(self.seen) > MEMORY:
            self.seen = {"": 0}

    def count(self, texts: list[str]) -> list[int]:
        pieces = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*pieces).difference(self.seen)
        if new:
            self.learn(new)
        of_piece = self.seen.__getitem__
        counts = [sum(map(of_piece, ps)) for ps in pieces]
        self.forget(new)
        return counts


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("tokens", _mergers.clear)
        counter = merger(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens: list[int] = []
            for i in range(0, len(texts), 256):
                tokens += counter.count(texts[i : i + 256])
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
