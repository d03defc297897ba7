"""Exact token counts of every prefix by dynamic programming, without encoding.

For byte-level BPE the last token of a prefix's encoding is the only vocabulary token t that ends the prefix and that
BPE leaves next to the last token of the prefix without t. So ``count[i] = count[i - len(t)] + 1``, and one pass over a
pre-token gives the count of each of its prefixes. Pre-tokens are independent: the counts of a text's prefixes are
running sums over its pre-tokens. ``PrefixCounts`` keeps them and answers truncation and budget questions.

Defined results: a null text has 0 bytes and 0 tokens; special strings inside texts count as one token; repeated rows
and other columns play no part; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arborlake.llm import bpe, pretokens
from arborlake.llm.shared import slices

LIMIT = 512


class Programme:
    """The dynamic programme over one vocabulary."""

    def __init__(self, vocab: bpe.Vocabulary) -> None:
        self.vocab = vocab
        self.token = {b: i for i, b in enumerate(vocab.bytes)}
        self.longest = max(map(len, self.token))
        self.known: dict[int, bool] = {}
        #: Tokens that BPE gives for their own bytes; others never end a prefix.
        good = [True] * 256
        for i in range(256, len(vocab.parts)):
            a, b = vocab.parts[i]
            good.append(good[a] and good[b] and self.stays(a, b, below=i))
        self.token = {b: i for b, i in self.token.items() if good[i]}

    def stays(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether BPE, on the bytes of a and b together, leaves no merge across them (of a rank under ``below``).

        Undo the later of the two tokens' merges step by step; while it lasts, only its part at the seam can merge
        across, and only by a merge of a smaller rank than the one undone.
        """
        parts, merged = self.vocab.parts, self.vocab.merged
        top = below if below is not None else 1 << 60
        while True:
            across = merged.get(a << 17 | b)
            if across is not None and across < top:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                top, a = a, parts[a][1]
            else:
                top, b = b + 1, parts[b][0]

    def prefixes(self, word: bytes) -> list[int]:
        """Token counts of all prefixes of a pre-token, from the empty one to the whole."""
        token, known, longest = self.token, self.known, self.longest
        last, count = [-1], [0]
        for i in range(1, len(word) + 1):
            for k in range(max(0, i - longest), i):
                t = token.get(word[k:i])
                if t is None:
                    continue
                if k:
                    pair = last[k] << 17 | t
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) > 2_000_000:
                            known.clear()
                        fits = known[pair] = self.stays(last[k], t)
                    if not fits:
                        continue
                last.append(t)
                count.append(count[k] + 1)
                break
        return count


@lru_cache(maxsize=2)
def programme(name: str = bpe.VOCABULARY) -> Programme:
    return Programme(bpe.vocabulary(name))


@lru_cache(maxsize=2)
def counter(name: str = bpe.VOCABULARY) -> bpe.Store:
    run = programme(name)

    def make(words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([1 if w is None else run.prefixes(w.encode())[-1] for w in words], dtype=np.uint32), np.ones(len(words), dtype=np.int64)

    return bpe.Store(make)


class PrefixCounts:
    """The token count of every prefix of one text, kept as an array: ``counts[i]`` for the first i characters.

    Inside a pre-token the programme gives the counts of all prefixes at once. The split itself can differ from that of
    the whole text where a prefix ends in white space, in a contraction or in the special token: there the last
    pre-tokens are split again while the array is made, and never afterwards.
    """

    def __init__(self, text: str, name: str = bpe.VOCABULARY) -> None:
        self.text, self.name = text, name
        special = bpe.vocabulary(name).special
        run = programme(name)
        s = pretokens.split([text], special)
        known = [None if w is None else run.prefixes(w.encode()) for w in s.words]
        counts = np.zeros(len(text) + 1, dtype=np.int64)
        starts, before, at, total = [], [], 0, 0
        for which in s.which.tolist():
            word = s.words[which]
            starts.append(at)
            before.append(total)
            size = len(special) if word is None else len(word)
            again = word is None or word[0] == "'" or word[-1].isspace() or word[0].isspace() and len(word) > 1 and word[1] == "'"
            if not again:
                bytes_at = np.cumsum([len(c.encode()) for c in word])
                counts[at + 1 : at + size + 1] = total + np.array(known[which], dtype=np.int64)[bytes_at]
            # a prefix that ends in white space may join it with what comes before
            for i in range(at + 1, at + size + 1) if again else [at + 1] if word[0].isspace() else []:
                k = max(0, len(starts) - 3)
                counts[i] = before[k] + self._total(text[starts[k] : i], special, run)
            at += size
            total += 1 if word is None else known[which][-1]
        self.counts = counts

    @staticmethod
    def _total(text: str, special: str, run: Programme) -> int:
        s = pretokens.split([text], special)
        return sum(1 if s.words[i] is None else run.prefixes(s.words[i].encode())[-1] for i in s.which.tolist())

    def at(self, chars: int) -> int:
        """How many tokens the text's first ``chars`` characters have."""
        return int(self.counts[chars])

    def total(self) -> int:
        return int(self.counts[-1])

    def cut(self, budget: int) -> int:
        """The most characters that have at most ``budget`` tokens (0 for a negative budget)."""
        return int(np.flatnonzero(self.counts <= max(0, budget))[-1])


def token_counts(docs: DataFrame, limit: int = LIMIT, name: str = bpe.VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, store = bpe.vocabulary(name), counter(name)
        for batch in slices(batches):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            sums = [np.empty(0, np.int64)]
            for group in pretokens.splits(texts, vocab.special):
                for s, rows in zip(group, store.look(group)):
                    before = np.concatenate(([0], np.cumsum(store.values[rows], dtype=np.int64)))
                    sums.append(np.diff(before[np.concatenate(([0], s.ends))]))
            counts = np.concatenate(sums)
            sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def truncated(docs: DataFrame, budget: int, name: str = bpe.VOCABULARY) -> DataFrame:
    """``docs`` with texts cut to the longest prefix of at most ``budget`` tokens; null texts stay null, all columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            texts = [None if t is None else t[: PrefixCounts(t, name).cut(budget)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op6(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
