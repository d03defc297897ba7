"""Byte-level BPE, encoding and decoding, with a pair occurrence index.

The different pre-tokens of a batch that were not seen before are laid out as one symbol list. The index maps each
pair's rank to the positions at which the pair occurs. Active ranks are applied in ascending order: a rank's positions
are merged from left to right, and the pairs that a merge makes with its neighbours enter the lists of their ranks.
A worker keeps the ids of up to STORE pre-tokens for later batches; which ones are kept does not change any result.

Defined results: a null text is empty and has no tokens; special strings inside texts become the special token;
repeated rows, ties and other columns play no part; empty tables give no rows. Memory is bound by a batch of rows and
by the longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm import pretokens
from arborlake.llm.shared import slices

VOCABULARY = "byte_bpe_50k.json"
STORE = 200_000


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable bytes themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """ids, merges and special token of a tokenizer file. Symbols are numbered by rank: 256 bytes, then merges in order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.special = told["added_tokens"][0]["content"]
        self.special_id = told["added_tokens"][0]["id"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.ids = [model["vocab"][c] for c in letters]
        number = {c: b for b, c in enumerate(letters)}
        self.merged: dict[int, int] = {}
        self.parts = [(b, b) for b in range(256)]
        self.bytes = [bytes([b]) for b in range(256)]
        for left, right in model["merges"]:
            a, b = number[left], number[right]
            new = len(self.parts)
            self.merged[a << 17 | b] = new
            number[left + right] = new
            self.parts.append((a, b))
            self.bytes.append(self.bytes[a] + self.bytes[b])
            self.ids.append(model["vocab"][left + right])
        self.pairs = np.array(sorted(self.merged), dtype=np.int64)
        self.ranks = np.array([self.merged[p] for p in self.pairs.tolist()], dtype=np.int64)
        self.ids_of = np.array(self.ids, dtype=np.uint32)
        self.token_bytes: list[bytes] = [b""] * (max(max(self.ids), self.special_id) + 1)
        for text, i in model["vocab"].items():
            self.token_bytes[i] = bytes(value[c] for c in text)
        self.token_bytes[self.special_id] = self.special.encode()


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name))


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in one array, and how many each word has. All positions of a rank are merged at once."""
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    symbols = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int32)
    n = len(symbols)
    ends = np.cumsum([len(w) for w in words])
    bounds = np.concatenate(([0], ends[:-1]))
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[bounds] = -1, -1
    where: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enter(left: np.ndarray, right: np.ndarray, positions: np.ndarray) -> None:
        """Puts positions into the lists of the ranks that their pairs have."""
        pairs = left.astype(np.int64) << 17 | right
        place = np.minimum(np.searchsorted(vocab.pairs, pairs), len(vocab.pairs) - 1)
        known = vocab.pairs[place] == pairs
        ranks = vocab.ranks[place[known]]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[known][order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for r, i, k in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:]):
            if r in where:
                where[r].append(positions[i:k])
            else:
                where[r] = [positions[i:k]]
                heapq.heappush(active, r)

    inner = np.flatnonzero(after >= 0)
    enter(symbols[inner], symbols[inner + 1], inner)
    while active:
        rank = heapq.heappop(active)
        left, right = vocab.parts[rank]
        lists = where.pop(rank)
        at = np.unique(np.concatenate(lists) if len(lists) > 1 else lists[0])
        j = after[at]
        good = (symbols[at] == left) & (j >= 0) & (symbols[j] == right)  # j = -1 reads the last symbol, which decides nothing
        at, j = at[good], j[good]
        if left == right and len(at) > 1:  # in a run of equal symbols each second pair goes, from the left
            index = np.arange(len(at))
            head = np.concatenate(([True], j[:-1] != at[1:]))
            each = (index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0
            at, j = at[each], j[each]
        if not len(at):
            continue
        k = after[j]
        symbols[at], symbols[j], after[at] = rank, -1, k
        follows = k >= 0
        before[k[follows]] = at[follows]
        h = before[at]
        h = h[h >= 0]
        enter(symbols[np.concatenate((at[follows], h))], symbols[np.concatenate((k[follows], after[h]))], np.concatenate((at[follows], h)))
    alive = symbols >= 0
    return symbols[alive], np.add.reduceat(alive, bounds, dtype=np.int64)


class Store:
    """What is known about pre-tokens: for each a run of numbers, made by ``make`` for all new ones of a batch together."""

    def __init__(self, make: Callable[[list[str | None]], tuple[np.ndarray, np.ndarray]], most: int = STORE) -> None:
        self.make, self.most = make, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str | None, int] = {}
        self.values = np.empty(0, dtype=np.uint32)
        self.starts = np.zeros(1, dtype=np.int64)

    def look(self, splits: list[pretokens.Split]) -> list[np.ndarray]:
        """The row of each pre-token of each split."""
        if len(self.place) > self.most:
            self.clear()
        fresh: dict[str | None, None] = {}
        for s in splits:
            for word in s.words:
                if word not in self.place:
                    fresh[word] = None
        if fresh:
            values, counts = self.make(list(fresh))
            base = len(self.starts) - 1
            self.place.update(zip(fresh, range(base, base + len(fresh))))
            self.values = np.concatenate((self.values, values.astype(np.uint32)))
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts)))
        return [np.array([self.place[w] for w in s.words], dtype=np.int64)[s.which] for s in splits]

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some rows in order, and how many come before each row (one more entry at the end)."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        take = np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends[:-1], sizes)
        return self.values[take], ends


@lru_cache(maxsize=2)
def encoder(name: str = VOCABULARY) -> Store:
    vocab = vocabulary(name)

    def make(words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        plain = [w.encode() for w in words if w is not None]
        symbols, counts = encode_words(plain, vocab)
        ids = vocab.ids_of[symbols]
        if len(plain) < len(words):
            is_special = np.array([w is None for w in words])
            every = np.ones(len(words), dtype=np.int64)
            every[~is_special] = counts
            out = np.full(int(every.sum()), vocab.special_id, dtype=np.uint32)
            out[np.repeat(~is_special, every)] = ids
            return out, every
        return ids, counts

    return Store(make)


def encode(texts: list[str | None], name: str = VOCABULARY) -> Iterator[np.ndarray]:
    """The ids of each text."""
    vocab, store = vocabulary(name), encoder(name)
    plain = ["" if t is None else t for t in texts]
    for group in pretokens.splits(plain, vocab.special):
        for s, rows in zip(group, store.look(group)):
            ids, before = store.expand(rows)
            cuts = before[s.ends]
            for a, b in zip(np.concatenate(([0], cuts[:-1])).tolist(), cuts.tolist()):
                yield ids[a:b]


def decode(ids: np.ndarray, name: str = VOCABULARY) -> str:
    """The text of some ids; bytes that are not UTF-8 become U+FFFD."""
    table = vocabulary(name).token_bytes
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


def encode_and_decode(docs: DataFrame, name: str = VOCABULARY, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row; with ``keep`` also ids (array<int>) and decoded."""
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    fields += [("ids", "array<int>"), ("decoded", "string")] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, again, kept, texts = [], [], [], [], []
            for ids in encode(batch.column(1).to_pylist(), name):
                text = decode(ids, name)
                sizes.append(len(ids))
                digests.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                again.append(hashlib.sha256(text.encode()).hexdigest())
                if keep:
                    kept.append(ids.astype(np.int32))
                    texts.append(text)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(again, pa.string())]
            columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())] if keep else []
            yield pa.RecordBatch.from_arrays(columns, names=[f for f, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{f} {t}" for f, t in fields))


def op4(docs: DataFrame) -> DataFrame:
    return encode_and_decode(docs)
