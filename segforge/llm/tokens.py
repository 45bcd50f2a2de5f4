"""Corpus encoding with a public byte-level BPE vocabulary: speculate, verify, repair.

The text is cut into words by the vocabulary's own pattern. Each word that a task hasn't met yet is *proposed* a
tokenisation by greedy longest match. A sequence is what the merges would give exactly when every two neighbouring
tokens are compatible: while both are being built, no merge across their border comes before the merges that finish
them. That test runs over arrays of all new neighbouring pairs at once. Only words with a failing pair are merged
exactly. The outcome is independent of batches and caches.

Defined results: null, empty text: an empty list. Texts of any length are encoded whole; a run of letters without a
break is one word. Special tokens are never made; their strings are ordinary text. Other columns are ignored, repeated
rows give repeated rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept by a task before its cache starts anew; bounds memory only, results don't depend on it.
CACHE_WORDS = 200_000
#: Documents worked on at a time.
SLICE = 256
DEFAULT_VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the
    others follow from U+0100 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in letters.values()]
    return letters | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE vocabulary with greedy proposals and exact repair."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        ids = model["vocab"]
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.single = np.zeros(256, np.int64)
        self.tokens: dict[bytes, int] = {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(ids.values()) + 1
        self.rank = np.full(size, -1, np.int64)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for c, b in letters.items():
            self.single[b] = ids[c]
            self.tokens[bytes([b])] = ids[c]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            a_id, b_id, made = ids[a], ids[b], ids[a + b]
            self.merge[a_id, b_id] = (r, made)
            if self.rank[made] < 0:
                self.rank[made], left[made], right[made] = r, a_id, b_id
                self.tokens[spell(a) + spell(b)] = made
        self.longest = max(map(len, self.tokens))
        #: Edges of a token's build tree: for each depth the outermost piece there and the rank of the merge that absorbs it.
        self.right_edge, self.right_until = self._edge(right)
        self.left_edge, self.left_until = self._edge(left)
        keys = np.array([a * size + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.size = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order], size
        self.known_pairs: dict[int, bool] = {}

    def _edge(self, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces, until = [np.arange(len(child))], [np.full(len(child), np.iinfo(np.int64).max)]
        while True:
            last = pieces[-1]
            following = np.where(last >= 0, child[np.maximum(last, 0)], -1)
            if (following < 0).all():
                return np.stack(pieces), np.stack(until)
            until.append(np.where(following >= 0, self.rank[np.maximum(last, 0)], -1))
            pieces.append(following)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the merges keep the border between each first[i] and second[i]; one array pass for each depth pair."""
        good = np.ones(len(first), bool)
        for i in range(len(self.right_edge)):
            a, a_until = self.right_edge[i][first], self.right_until[i][first]
            if (a < 0).all():
                break
            for j in range(len(self.left_edge)):
                b, b_until = self.left_edge[j][second], self.left_until[j][second]
                live = np.flatnonzero((a >= 0) & (b >= 0) & good)
                if not len(live):
                    break
                key = a[live] * self.size + b[live]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)
                good[live[(rank < a_until[live]) & (rank <= b_until[live])]] = False
        return good

    def propose(self, word: bytes) -> list[int]:
        out, at, n, tokens = [], 0, len(word), self.tokens
        whole = tokens.get(word)
        if whole is not None:
            return [whole]
        while at < n:
            end = min(n, at + self.longest)
            while (token := tokens.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, leftmost first, with a heap: n log n in the word's length."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after, merge = list(range(-1, n - 1)), list(range(1, n + 1)), self.merge
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merge.get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := merge.get((ids[before[i]], made))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], made, m[1]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Speculate on all words, verify all their unknown neighbouring pairs together, repair what fails."""
        raw = [w.encode("utf-8", "replace") for w in words]
        proposals = [self.propose(w) for w in raw]
        pairs = {a * self.size + b for p in proposals if len(p) > 1 for a, b in zip(p, p[1:])}
        fresh = np.fromiter((k for k in pairs if k not in self.known_pairs), np.int64)
        if len(fresh):
            if len(self.known_pairs) > 4 * CACHE_WORDS:
                self.known_pairs.clear()
                fresh = np.fromiter(pairs, np.int64)
            self.known_pairs.update(zip(fresh.tolist(), self.compatible(fresh // self.size, fresh % self.size).tolist()))
        fits, size = self.known_pairs, self.size
        return [p if all(fits[a * size + b] for a, b in zip(p, p[1:])) else self.exact(w) for w, p in zip(raw, proposals)]


class Corpus:
    """Encoding of many texts by one task, each distinct word worked on once."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n, len(array)), array.dtype)])

    def learn(self, words: list[str]) -> None:
        first = len(self.at)
        coded = self.encoder.encode_words(words)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        self.starts, self.sizes = self._room(self.starts, first + len(words)), self._room(self.sizes, first + len(words))
        self.flat = self._room(self.flat, self.used + int(sizes.sum()))
        self.sizes[first : first + len(words)] = sizes
        self.starts[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + int(sizes.sum())] = [x for c in coded for x in c]
        self.used += int(sizes.sum())
        self.at.update(zip(words, range(first, first + len(words))))

    def encode(self, texts: list[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self.at) > CACHE_WORDS:
            self.forget()
        split = [self.encoder.words(t) if t else [] for t in texts]
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in self.at))
        if fresh:
            self.learn(fresh)
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        get = self.at.__getitem__
        which = np.fromiter((get(w) for words in split for w in words), np.int64, int(n_words.sum()))
        sizes = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        lengths = ends[bounds[1:]] - ends[bounds[:-1]]
        if counts_only:
            return np.zeros(0, np.int32), lengths
        take = np.repeat(self.starts[which] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[take], lengths


_LOADED: dict[str, Corpus] = {}


def corpus_of(path: str) -> Corpus:
    if path not in _LOADED:
        _LOADED[path] = Corpus(path)
    return _LOADED[path]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row."""
    path = path or vocabulary_path()

    def run(batches):
        corpus = corpus_of(path)
        for batch in _batches(batches):
            ids, lengths = corpus.encode(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count(df: DataFrame, text: str = "text", into: str = "n_tokens", path: str | None = None) -> DataFrame:
    """The rows without ``text`` and with the number of its tokens."""
    path = path or vocabulary_path()
    rest = [c for c in df.columns if c != text]

    def run(batches):
        corpus = corpus_of(path)
        for batch in _batches(batches):
            _, lengths = corpus.encode(batch.column(len(rest)).to_pylist(), counts_only=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(lengths, pa.int64())], names=[*rest, into])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + f", `{into}` bigint"
    return df.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)
