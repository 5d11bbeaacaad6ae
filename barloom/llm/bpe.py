"""Encoding of a corpus with a public byte-level BPE vocabulary (rank file).

Method: speculate and verify.  The distinct words of a batch are cut by greedy longest
match; a sequence of tokens is what the merges would give if and only if each two neighbours
are, so one vectorised test over all adjacent pairs verifies all words at once, and only the
words that fail it are merged exactly.  A long word is merged exactly only around the borders that
fail, and the widened result is verified again, so its cost stays near its length.  Verified words
are kept in a cache of the worker.

The driver derives the tables (token split by its last merge, sorted merge pairs) from the
rank file once and broadcasts them; their size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries after which a worker's word cache starts anew (memory only; results don't depend on it).
CACHE_WORDS = 400_000
#: Words over so many characters aren't kept in the cache.
CACHE_CHARS = 256
#: Bytes up to which a word is merged as a whole by scanning for the lowest merge.
SCAN_BYTES = 128
#: Characters of text encoded per output batch.
BATCH_CHARS = 4_000_000
_SHIFT = 20


class Vocabulary:
    """Rank tables of a byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        if size >= 1 << _SHIFT:
            raise ValueError("vocabulary too large")
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = _merge([ranks[token[i : i + 1]] for i in range(len(token))], pairs)
                if len(parts) == 2:  # else no merge leads to it and it is never produced
                    pairs[parts[0], parts[1]] = rank
                    self.left[rank], self.right[rank] = parts
        self.pairs = pairs
        keys = np.array([(a << _SHIFT) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ids = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            head = token[:2]
            self.reach[head] = max(self.reach.get(head, 1), len(token))
        whole = {t: r for t, r in ranks.items() if len(t) == 1 or self.left[r] != r}
        self.speculated = whole
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.token_of = {r: t for t, r in ranks.items()}

    def greedy(self, word: bytes) -> list[int]:
        """Longest match first."""
        out, at, n, known, reach = [], 0, len(word), self.speculated, self.reach
        while at < n:
            end = min(n, at + reach.get(word[at : at + 2], 1))
            while end > at + 1 and word[at:end] not in known:
                end -= 1
            out.append(known[word[at:end]])
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would the merges leave this border alone?

        Both tokens are undone from their outer sides towards the border, later merges first;
        the border fails if the two pieces that face each other merge before either is taken up.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        fine = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            key = (x << _SHIFT) | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            broken = (self.pair_keys[at] == key) & (self.pair_ids[at] < limit[live])
            fine[live[broken]] = False
            live = live[~broken]
            x, y = a[live], b[live]
            # the side whose token was made later is undone; on a tie the right one, as merges go from the left
            undo_left = x > y
            can_left, can_right = self.right[x] != x, self.left[y] != y
            go_left = np.where(undo_left, can_left, ~can_right & can_left)
            go_right = ~go_left & can_right
            limit[live] = np.where(go_left, x, np.where(go_right, y + 1, limit[live]))
            a[live] = np.where(go_left, self.right[x], x)
            b[live] = np.where(go_right, self.left[y], y)
            live = live[go_left | go_right]
        return fine

    def exact(self, word: bytes) -> list[int]:
        merge = _merge if len(word) <= SCAN_BYTES else _merge_long
        return merge([self.byte_ids[c] for c in word], self.pairs)

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, back = np.unique((a << _SHIFT) | b, return_inverse=True)
        return self.compatible(keys >> _SHIFT, keys & ((1 << _SHIFT) - 1))[back]

    def repair(self, word: bytes, ids: list[int]) -> list[int]:
        """The tokens of a long word from a first guess: stretches around failing borders are merged exactly.

        A stretch that borders a failing pair after its merge is widened, to twice its tokens at
        least, until all pairs are compatible; at worst the whole word is one stretch.
        """
        tokens = np.array(ids, np.int64)
        reach = 2
        while len(tokens) > 1:
            bad = np.flatnonzero(~self._fits(tokens[:-1], tokens[1:]))
            if not len(bad):
                break
            ends = np.concatenate(([0], np.cumsum([len(self.token_of[t]) for t in tokens])))
            parts, done, i = [], 0, 0
            while i < len(bad):
                lo, hi = max(done, bad[i] - reach + 1), min(len(tokens), bad[i] + 1 + reach)
                while i + 1 < len(bad) and bad[i + 1] - reach + 1 <= hi:
                    i += 1
                    hi = min(len(tokens), bad[i] + 1 + reach)
                parts += [tokens[done:lo], np.array(self.exact(word[ends[lo] : ends[hi]]), np.int64)]
                done, i = hi, i + 1
            tokens = np.concatenate([*parts, tokens[done:]])
            reach *= 2
        return tokens.tolist()

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (a match of the pre-split pattern)."""
        raw = [w.encode("utf-8", "replace") for w in words]
        spec = self.speculated
        ids = [[spec[w]] if w in spec else self.greedy(w) for w in raw]
        many = [i for i, t in enumerate(ids) if len(t) > 1]
        if many:
            lens = np.fromiter((len(ids[i]) for i in many), np.int64, len(many))
            flat = np.fromiter((t for i in many for t in ids[i]), np.int64, int(lens.sum()))
            owner = np.repeat(np.arange(len(many)), lens)
            inner = owner[1:] == owner[:-1]
            a, b, own = flat[:-1][inner], flat[1:][inner], owner[1:][inner]
            for j in np.unique(own[~self._fits(a, b)]):
                i = many[j]
                ids[i] = self.exact(raw[i]) if len(raw[i]) <= SCAN_BYTES else self.repair(raw[i], ids[i])
        return ids


def _merge(parts: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """Exact merging: the lowest merge of all neighbours first, leftmost first."""
    none = 1 << 62
    parts = list(parts)
    get = pairs.get
    ranks = [get(p, none) for p in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == none:
            break
        i = ranks.index(low)
        parts[i : i + 2] = [low]
        del ranks[i]
        if i < len(ranks):
            ranks[i] = get((parts[i], parts[i + 1]), none)
        if i:
            ranks[i - 1] = get((parts[i - 1], parts[i]), none)
    return parts


def _merge_long(parts: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same by a heap over linked positions, for long words."""
    n, get = len(parts), pairs.get
    parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := get(p)) is not None]
    heapq.heapify(heap)
    while heap:
        low, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= n or get((parts[i], parts[j])) != low:
            continue  # one of the two was taken up before
        parts[i], parts[j] = low, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := get((low, parts[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := get((parts[h], low))) is not None:
            heapq.heappush(heap, (r, h))
    return [p for p in parts if p >= 0]


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return Vocabulary(ranks)


class Encoder:
    """A vocabulary with a cache of words; one for each worker process."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give an empty list."""
        split = [self.split(t) if t else [] for t in texts]
        seen: set[str] = set()
        for words in split:
            seen.update(words)
        missing = seen.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_WORDS:
            self.cache.clear()
            missing = seen
        held = self.cache
        if missing:
            fresh = list(missing)
            held.update(zip(fresh, self.vocabulary.encode_words(fresh)))
        get = held.__getitem__
        out = [[i for ids in map(get, words) for i in ids] for words in split]
        for w in missing:
            if len(w) > CACHE_CHARS:
                del held[w]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(key: str, packed: bytes) -> Encoder:
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(pickle.loads(packed))
    return _ENCODERS[key]


def _pack(df: DataFrame, path: str):
    packed = pickle.dumps(load_vocabulary(path), protocol=5)
    return df.sparkSession.sparkContext.broadcast(packed)


def _batches(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of about BATCH_CHARS characters, so that very long texts don't pile up."""
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= BATCH_CHARS or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            start, held = i + 1, 0


def encode_column(df: DataFrame, key: str, text: str = "text", *, vocabulary: str = f"{TOKENIZER_DIR}/{BYTE_BPE_50K}") -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens.

    A null or an empty text gives an empty list; strings that look like special tokens are
    ordinary text.  Rows are neither dropped nor merged: repeated rows come out repeatedly.
    """
    shared = _pack(df, vocabulary)
    kind = df.schema[key].dataType

    def run(batches):
        enc = encoder_of(vocabulary, shared.value)
        for batch in batches:
            for part, texts in _batches(batch, "__text"):
                ids = enc.encode(texts)
                lens = np.fromiter(map(len, ids), np.int32, len(ids))
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum(lens, out=offsets[1:])
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    src = df.select(F.col(key), F.col(text).cast("string").alias("__text"))
    return src.mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", *, vocabulary: str = f"{TOKENIZER_DIR}/{BYTE_BPE_50K}") -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (bigint; 0 for null and empty texts)."""
    shared = _pack(df, vocabulary)

    def run(batches):
        enc = encoder_of(vocabulary, shared.value)
        for batch in batches:
            for part, texts in _batches(batch, "__text"):
                n = pa.array([len(x) for x in enc.encode(texts)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], n], [*keep, "n_tokens"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep) + ", n_tokens bigint"
    return df.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
