"""Repeated passages, by merging shard Burrows-Wheeler transforms with iterative interleave refinement.

Two kinds of windows are looked for: any LENGTH bytes, and passages, which begin and end with words and have at least
WORDS words and PASSAGE bytes. A window is repeated if the same bytes are also a window of its kind elsewhere.

The transform is kept over sampled suffixes and wide symbols. The sample of a window is the position with the smallest
8-byte hash among its first ``step`` positions, so it depends on the window alone, and equal windows have equal samples.
A sample's symbol is the ``width`` bytes from it, which all windows with that sample hold; the symbols of consecutive
samples overlap, so a run of symbols, with the gaps between them, spells a run of text.

Each shard (about PIECE bytes of a task's texts) sorts its sampled suffixes by doubling ranks and has their
Burrows-Wheeler transform and LF mapping (``Transform``). Prefixes grow by LF steps: a suffix's prefix of h + 1 symbols
is the transform's letter before the digest of the following suffix's prefix of h symbols. Digests mean the same in all
shards, so the interleave of the shards is a set of blocks, each holding what the shards have for one common prefix.
Shards exchange block sizes only, never suffixes that are settled, at these depths:

1. one symbol: in a block with one suffix in all shards no window repeats;
2. the symbols that spell all windows of a sample: if a block does not split there, its common prefix covers the
   windows and all of them repeat; so do those of a prefix that occurs twice in a block that splits;
3. the symbols that all LENGTH bytes of a sample hold: if all suffixes with this inner run have one prefix, no byte
   window is left there;
4. what is left, byte by byte, against one suffix for each prefix of its block: passages, and cells of CELL windows;
   a cell holds bytes that all its windows have, and a block of cells with these bytes is refined like any other, by
   the bytes of all their windows;
5. the single windows of cells that stay undecided.

Suffixes of different shards are never sorted together, blocks are counted with partial sums and never gathered, and
each round reads what the round before left. Prefixes of one block are told apart by 64-bit digests, so an error needs
two of one block to agree by chance; bytes have 128-bit digests.

Defined results: a null text is empty; texts under LENGTH bytes and without passages lose nothing; windows never cross
documents; repeated rows repeat each other, whatever their doc_id; empty tables give no rows; other columns are not
read by the query and stay as they are in ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.shared import free, measured, release, slices, text_key, written

LENGTH = 400
WORDS = 51
PASSAGE = 256
GRAM = 8
PIECE = 1 << 20
CELL = 8
BATCH = 1 << 14
#: Texts whose keys are broadcast at most (some 10 MB), to leave other texts where they are; beyond it all texts are shuffled.
FEW = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit digest of two 64-bit numbers, in this order."""
    h = (a ^ (a >> _C)) * _A + b
    h = (h ^ (h >> _C)) * _B
    return h ^ (h >> _C)


def sampling(shortest: int) -> tuple[int, int]:
    """step, width: among how many first positions a window's sample is, and how many bytes from it all windows hold."""
    step = 1 << ((shortest + 1) // 2).bit_length() - 1
    return step, shortest - step + 1


def samples(data: bytes, step: int) -> np.ndarray:
    """For each position the sample of a window that begins there: the first of the smallest hashes of ``step`` positions."""
    n = len(data) - GRAM + 1
    if n < step:
        return np.empty(0, dtype=np.int64)
    grams = np.ndarray((n,), "<u8", data, 0, (1,))
    low = ((grams * _A) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    k = 1
    while k < step:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Transform:
    """The Burrows-Wheeler transform of a shard's sampled texts: letter numbers in text order, each text ended by a sign of its own."""

    def __init__(self, letter: np.ndarray, own: np.ndarray) -> None:
        n = len(letter)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if n else np.empty(0, np.int64)
        ends = np.append(first[1:], n) if n else first
        end_of = np.repeat(ends, ends - first)
        rank = np.unique(letter, return_inverse=True)[1].astype(np.int64)
        kinds, k, place = rank.max(initial=-1) + 1, 1, np.arange(n)
        while kinds < n:  # rank by twice as many symbols; texts that end alike stay equal
            following = np.where(place + k < end_of, np.append(rank, np.zeros(k, np.int64))[k:] + 1, 0)
            rank = np.unique(rank * (n + 1) + following, return_inverse=True)[1].astype(np.int64)
            more = rank.max() + 1
            if more == kinds:
                break
            kinds, k = more, 2 * k
        self.suffixes = np.argsort(rank, kind="stable")  # sorted suffixes; before them come the texts' empty ones
        self.row = np.empty(n, dtype=np.int64)
        self.row[self.suffixes] = np.arange(n) + len(first)
        before = np.arange(-1, n)
        before[first] = -1
        before = np.concatenate((ends - 1, before[self.suffixes]))
        self.known = np.flatnonzero(before >= 0)
        self.letter = letter[before[self.known]]  # the transform, without the texts' beginnings
        self.lf = np.empty(len(self.known), dtype=np.int64)
        self.lf[np.argsort(self.letter, kind="stable")] = np.arange(n) + len(first)
        self.texts = len(first)

    def prefixes(self, symbol: np.ndarray, suffix: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Digests of the first ``depth`` symbols of the asked suffixes, by LF steps over all rows."""
        out = np.zeros(len(suffix), dtype=np.uint64)
        order = np.argsort(depth, kind="stable")
        rows, deep = self.row[suffix[order]], depth[order]
        digest = np.zeros(len(symbol) + self.texts, dtype=np.uint64)
        digest[self.row] = symbol
        at = 0
        for h in range(1, int(deep[-1]) + 1 if len(deep) else 0):
            to = np.searchsorted(deep, h, side="right")
            out[order[at:to]] = digest[rows[at:to]]
            at = to
            longer = np.zeros_like(digest)
            longer[self.lf] = mixed(self.letter, digest[self.known])
            digest = longer
        out[order[at:]] = digest[rows[at:]]
        return out


def passages(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each passage: from each word, the shortest run of whole words that is one; none crosses texts."""
    word = ~((data == 0x20) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[starts] = True
    edge[-1] = True
    lo = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    hi = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    if len(lo) == 0:
        return lo, hi
    last = np.maximum(np.arange(len(lo)) + words - 1, np.searchsorted(hi, lo + least))
    ok = last < len(lo)
    lo, hi = lo[ok], hi[last[ok]]
    text = np.searchsorted(starts, lo, side="right") - 1
    ok = hi <= starts[text] + sizes[text]
    return lo[ok], hi[ok]


def _heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


def suffixes(texts: list[bytes], length: int, words: int, least: int) -> tuple[np.ndarray, ...]:
    """For each sample with windows: text number, first window, windows, sample, begin, end and number of its passages, block, inner run, prefix."""
    step, width = sampling(min(length, least))
    texts_at = np.flatnonzero(np.array([len(t) for t in texts]) >= min(length, least)) if texts else np.empty(0, np.int64)
    texts = [texts[i] for i in texts_at]
    none = np.empty(0, dtype=np.int32)
    if not texts:
        return np.empty(0, np.int64), none, none, none, none, none, none, *[np.empty(0, np.int64)] * 3
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    data = b"".join(texts)
    sample_of = samples(data, step)

    def starting(tail: int) -> np.ndarray:
        """Positions from which at least ``tail`` bytes of the text follow."""
        ok = np.ones(len(data), dtype=bool)
        for s, z in zip(starts.tolist(), sizes.tolist()):
            ok[max(s, s + z - tail + 1) : s + z] = False
        return np.flatnonzero(ok)

    # sampled suffixes: a text's beginning, and the samples of all windows inside it
    seen = sample_of[starting(step + GRAM - 1)]
    at = np.unique(np.concatenate((starts, seen[_heads(seen)])))
    own = np.searchsorted(starts, at, side="right") - 1
    ends = starts[own] + sizes[own]
    final = np.append(own[1:] != own[:-1], True)
    stop = np.where(final, ends, np.minimum(at + width, ends))  # a text's last symbol goes on to its end
    view, digest = memoryview(data), xxhash.xxh3_64_digest
    number = lambda lo, hi: np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist())]), dtype=">u8").astype(np.uint64)
    symbol = number(at, stop)
    block = symbol.copy()
    block[final] = number(at[final], np.minimum(at + width, ends)[final])
    gap = np.where(final, 0, np.append(at[1:], 0) - at).astype(np.uint64)
    transform = Transform(mixed(symbol, gap), own)
    # windows of LENGTH bytes, by their sample: windows with the same sample are consecutive
    first = np.full(len(at), len(data) + 1)
    span = np.zeros(len(at), dtype=np.int64)
    begins = starting(length)
    heads = _heads(sample_of[begins])
    which = np.searchsorted(at, sample_of[begins[heads]])
    first[which] = begins[heads]
    span[which] = np.diff(np.append(heads, len(begins)))
    # passages, by their sample
    lo, hi = passages(np.frombuffer(data, dtype=np.uint8), starts, sizes, words, least)
    p_lo, p_hi, p_span = np.full(len(at), len(data) + 1), np.full(len(at), -1), np.zeros(len(at), dtype=np.int64)
    shape = np.zeros(len(at), dtype=np.uint64)
    if len(lo):
        from_sample = sample_of[lo]
        heads = _heads(from_sample)
        which = np.searchsorted(at, from_sample[heads])
        p_lo[which], p_hi[which], p_span[which] = lo[heads], hi[np.append(heads[1:], len(hi)) - 1], np.diff(np.append(heads, len(lo)))
        shape[which] = np.add.reduceat(mixed((lo - from_sample).astype(np.uint64), (hi - from_sample).astype(np.uint64)), heads)
    # the run of symbols that spells all windows of a sample
    some = np.flatnonzero((span > 0) | (p_hi >= 0))
    begin = np.minimum(first[some], p_lo[some])
    end = np.maximum(np.where(span[some] > 0, first[some] + span[some] - 1 + length, -1), p_hi[some])
    x = np.searchsorted(at, begin, side="right") - 1
    y = np.searchsorted(stop, end)
    prefix = transform.prefixes(symbol, x, y - x + 1)
    # the run of symbols that all LENGTH bytes with the sample hold
    inner = transform.prefixes(block, some, np.maximum(np.searchsorted(at + width, at[some] + length - step + 1, side="right") - some, 1))
    shape = mixed(shape[some], mixed((at[some] - np.where(span[some] > 0, first[some], at[some])).astype(np.uint64) + (at[some] - at[x]).astype(np.uint64) * _A, span[some].astype(np.uint64)))
    base = starts[own[some]]
    bytes_from = np.where(span[some] > 0, first[some] - base, 0)
    words_from, words_to = np.where(p_hi[some] >= 0, p_lo[some] - base, 0), np.where(p_hi[some] >= 0, p_hi[some] - base, 0)
    return (
        texts_at[own[some]], bytes_from.astype(np.int32), span[some].astype(np.int32), (at[some] - base).astype(np.int32), words_from.astype(np.int32), words_to.astype(np.int32), p_span[some].astype(np.int32),
        block[some].view(np.int64), inner.view(np.int64), mixed(prefix, shape).view(np.int64),
    )


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def _runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, size, run = 0, 0, []
    for i, t in enumerate(texts):
        run.append(t)
        size += len(t)
        if size >= PIECE:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run


def shard_blocks(docs: DataFrame, *windows: int) -> DataFrame:
    """block, suffixes, low, high: each shard's sampled suffixes by their first symbol, with the least and greatest prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, texts in _runs(_texts(batch.column(0))):
                *_, blocks, _, prefixes = suffixes(texts, *windows)
                order = np.lexsort((prefixes, blocks))
                blocks, prefixes = blocks[order], prefixes[order]
                heads = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1]))) if len(blocks) else np.empty(0, np.int64)
                ends = np.concatenate((heads[1:], [len(blocks)])) if len(blocks) else heads
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks[heads]), pa.array(ends - heads), pa.array(prefixes[heads]), pa.array(prefixes[ends - 1])],
                    names=["block", "suffixes", "low", "high"],
                )

    return docs.select("text").mapInArrow(run, "block long, suffixes long, low long, high long")


def shard_suffixes(docs: DataFrame, *windows: int) -> DataFrame:
    """doc_id, text_key, near, far, block, inner, prefix: each sample with its windows, packed (see ``_unpacked``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "near", "far", "block", "inner", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for at, texts in _runs(_texts(batch.column(2))):
                own, *places, block, inner, prefix = suffixes(texts, *windows)
                first, span, sample, words_from, words_to, number = (c.astype(np.int64) for c in places)
                near = sample << 32 | np.where(span > 0, sample - first, 0) << 16 | span
                far = np.where(number > 0, sample - words_from, 0) << 48 | number << 32 | np.where(number > 0, words_to - sample, 0)
                take = pa.array(own + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, (near, far, block, inner, prefix))], names=names)

    schema = f"doc_id {kind}, text_key long, near long, far long, block long, inner long, prefix long"
    return docs.select("doc_id", "text_key", "text").mapInArrow(run, schema)


def _unpacked(rows: DataFrame) -> DataFrame:
    """The same with first, span, sample, words_from, words_to and passages as columns; distances to a sample are under 2^15."""
    part = lambda c, at, bits: F.shiftright(c, at).bitwiseAND(F.lit((1 << bits) - 1))
    sample, far, near = F.shiftright("near", 32), F.col("far"), F.col("near")
    places = {
        "first": F.when(part(near, 0, 16) > 0, sample - part(near, 16, 16)).otherwise(0), "span": part(near, 0, 16), "sample": sample,
        "words_from": F.when(part(far, 32, 16) > 0, sample - part(far, 48, 15)).otherwise(0),
        "words_to": F.when(part(far, 32, 16) > 0, sample + part(far, 0, 32)).otherwise(0), "passages": part(far, 32, 16),
    }
    return rows.withColumns({k: v.cast("int") for k, v in places.items()}).drop("near", "far")


def _of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text_key are among ``keys`` (k_id, k_key), or are not: left_semi or left_anti."""
    return docs.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_key")), how)


def _keys(rows: DataFrame) -> tuple[DataFrame, bool]:
    """k_id, k_key: the texts that the rows are about, and whether they are few enough for a broadcast."""
    keys, seen = measured(rows.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key")).distinct(), "keys", n=F.count("*"))
    return keys, seen["n"] <= FEW


def _asked(docs: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """doc_id, text_key, text, asked: the texts of the asked rows, with what is asked of them."""
    lists = asked.select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), F.struct(*columns).alias("one"))
    lists = lists.groupBy("w_id", "w_key").agg(F.collect_list("one").alias("asked"))  # at most the windows of one text
    keys, few = _keys(asked)
    if few:  # other texts need not be shuffled
        docs = _of(docs, keys, "left_semi")
    # a repeated row is asked twice about windows that are not alone, which changes no result
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")))
    return joined.select("doc_id", "text_key", "text", "asked")


def _digested(asked: DataFrame, pieces, names: str, types: list[pa.DataType]) -> DataFrame:
    """doc_id, text_key and the rows that ``pieces`` makes of each text and what is asked of it, BATCH rows at a time."""
    kind = asked.schema["doc_id"].dataType.simpleString()
    fields = ["doc_id", "text_key", *(n.split()[0] for n in names.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            own: list[int] = []
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                take = pa.array(own, pa.int64())
                made = pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names=fields)
                own.clear()
                rows.clear()
                return made

            for i in range(batch.num_rows):
                for row in pieces(batch.column(2)[i].as_py().encode(), batch.column(3)[i].as_py()):
                    own.append(i)
                    rows.append(row)
                    if len(rows) >= BATCH:
                        yield flush()
            if rows:
                yield flush()

    return asked.mapInArrow(run, f"doc_id {kind}, text_key long, {names}")


def _two(data: memoryview) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(data)
    return (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)


def cells_of(docs: DataFrame, asked: DataFrame, length: int, words: int, least: int) -> DataFrame:
    """doc_id, text_key, lo, number, hi, alone, inner, outer, outer2: the cells and passages (number 0) of the asked suffixes.

    Cells lie on a grid that the sample gives. inner: bytes that all windows of the grid's cell hold; outer: those of
    the windows that are there, lo to hi.
    """

    def pieces(text: bytes, asked: list[dict]) -> Iterator[tuple]:
        view = memoryview(text)
        lo, hi = passages(np.frombuffer(text, dtype=np.uint8), np.zeros(1, np.int64), np.array([len(text)]), words, least) if any(a["passages"] for a in asked) else (None, None)
        for one in asked:
            a, stop, sample, alone = one["first"], one["first"] + one["span"], one["sample"], one["alone"]
            while a < stop:
                grid = sample + (a - sample) // CELL * CELL
                b = min(grid + CELL, stop)
                inner = xxhash.xxh3_64_intdigest(view[grid + CELL - 1 : grid + length]) if length >= CELL else 0
                outer = _two(view[a : b - 1 + length])
                yield a, b - a, b - 1 + length, alone, inner - (1 << 63), outer[0] ^ (a - grid) << 8 ^ (b - a), outer[1]
                a = b
            if one["passages"]:
                p = np.searchsorted(lo, one["words_from"])
                for x, y in zip(lo[p : p + one["passages"]].tolist(), hi[p : p + one["passages"]].tolist()):
                    outer = _two(view[x:y])
                    yield x, 0, y, alone, outer[0] ^ outer[1], *outer

    types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    names = "lo int, number int, hi int, alone boolean, inner long, outer long, outer2 long"
    return _digested(_asked(docs, asked, ["first", "span", "sample", "words_from", "passages", "alone"]), pieces, names, types)


def windows_of(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """doc_id, text_key, lo, alone, digest, digest2: the windows of the asked cells, one row each."""

    def pieces(text: bytes, asked: list[dict]) -> Iterator[tuple]:
        view = memoryview(text)
        for one in asked:
            for a in range(one["lo"], one["lo"] + one["number"]):
                yield a, one["alone"], *_two(view[a : a + length])

    return _digested(_asked(docs, asked, ["lo", "number", "alone"]), pieces, "lo int, alone boolean, digest long, digest2 long", [pa.int32(), pa.bool_(), pa.int64(), pa.int64()])


def repeated_spans(docs: DataFrame, length: int = LENGTH, words: int = WORDS, least: int = PASSAGE) -> DataFrame:
    """doc_id, text_key, spans (array of struct(lo, hi, words_lo, words_hi), bytes): windows and passages that occur elsewhere too.

    ``docs``: doc_id, text_key, text. Where a span has no bytes or no words, both ends are equal.
    """
    cut = [
        "doc_id", "text_key", F.col("first").alias("lo"), F.when(F.col("span") > 0, F.col("first") + F.col("span") - 1 + length).otherwise(F.col("first")).alias("hi"),
        F.col("words_from").alias("words_lo"), F.col("words_to").alias("words_hi"),
    ]
    blocks = shard_blocks(docs, length, words, least).groupBy(F.col("block").alias("b_block")).agg(
        F.sum("suffixes").alias("suffixes"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    # a table of its own, so that the join below can split a block that holds many suffixes
    blocks = written(blocks.where("suffixes > 1").select("b_block", (F.col("low") != F.col("high")).alias("splits")), "blocks")
    active = shard_suffixes(docs, length, words, least).join(blocks, F.col("block") == F.col("b_block")).drop("b_block")
    active = written(_unpacked(active), "suffixes")
    free(blocks)
    settled = active.where("not splits").select(*cut)
    split = active.where("splits")
    one = F.struct("doc_id", "text_key", "first", "span", "sample", "words_from", "passages")
    prefixes = split.groupBy("block", "prefix").agg(F.count("*").alias("n"), F.min("inner").alias("inner"), F.min(one).alias("one"))
    prefixes = written(prefixes, "prefixes")  # the prefix spells the inner run, so its suffixes have the same one
    shared = prefixes.where("n > 1").select(F.col("block").alias("c_block"), F.col("prefix").alias("c_prefix"))
    whole = split.join(shared, (F.col("block") == F.col("c_block")) & (F.col("prefix") == F.col("c_prefix"))).select(*cut)
    inners = _undecided(prefixes, "inner")
    asked = prefixes.join(inners, F.col("inner") == F.col("u_inner"), "left").select("one.*", (F.col("n") == 1).alias("alone"), "u_inner")
    asked = asked.withColumn("span", F.when(F.col("u_inner").isNotNull(), F.col("span")).otherwise(0)).where("span > 0 or passages > 0")
    # cells, in the same way: a block has the inner bytes, its cells are refined by the outer ones
    parts = written(cells_of(docs, asked, length, words, least), "parts")
    free(inners)
    one = F.struct("doc_id", "text_key", "lo", "number", "alone")
    kinds = parts.groupBy("inner", "outer", "outer2").agg(F.count("*").alias("n"), F.min(one).alias("one"))
    kinds = written(kinds.where("n > 1 or one.number > 0"), "kinds")  # a passage that occurs once is settled
    release(kinds)
    shared = kinds.where("n > 1").select(F.col("outer").alias("c_outer"), F.col("outer2").alias("c_outer2"), F.col("inner").alias("c_inner"))
    same = (F.col("outer") == F.col("c_outer")) & (F.col("outer2") == F.col("c_outer2")) & (F.col("inner") == F.col("c_inner"))
    found = parts.where("alone").join(shared, same)
    partly = found.select("doc_id", "text_key", *[F.when((F.col("number") == 0) == words_too, F.col(c)).otherwise(F.lit(0)).alias(to) for words_too, c, to in
                          [(False, "lo", "lo"), (False, "hi", "hi"), (True, "lo", "words_lo"), (True, "hi", "words_hi")]])
    undecided = _undecided(kinds.where("one.number > 0"), "inner")
    asked = kinds.where("one.number > 0").join(undecided, F.col("inner") == F.col("u_inner"))
    asked = asked.select("one.doc_id", "one.text_key", "one.lo", "one.number", ((F.col("n") == 1) & F.col("one.alone")).alias("alone"))
    single = written(windows_of(docs, asked, length), "windows")
    free(undecided)
    twice = single.groupBy(F.col("digest").alias("d_digest"), F.col("digest2").alias("d_digest2")).agg(F.count("*").alias("n")).where("n > 1")
    twice = written(twice, "twice")
    release(twice)
    last = single.where("alone").join(twice, (F.col("digest") == F.col("d_digest")) & (F.col("digest2") == F.col("d_digest2"))).select(
        "doc_id", "text_key", "lo", (F.col("lo") + length).alias("hi"), F.lit(0).alias("words_lo"), F.lit(0).alias("words_hi")
    )
    # a set: the spans of a row that is repeated are those of one
    spans = settled.union(whole).union(partly).union(last).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("lo", "hi", "words_lo", "words_hi")).alias("spans"))
    spans = written(spans, "spans")
    free(active, prefixes, parts, kinds, single, twice)
    return spans


def _undecided(kinds: DataFrame, inner: str) -> DataFrame:
    """u_inner: the blocks that hold more than one kind, as a table of its own that a skewed join can read."""
    many = kinds.groupBy(F.col(inner).alias("u_inner")).agg(F.count("*").alias("kinds")).where("kinds > 1")
    return written(many.select("u_inner"), "undecided")


def merged(spans: pa.Array, *fields: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, begin and end of each run that a text's spans cover, in order, for a list of spans (structs) for each text.

    ``fields`` name the ends that count. Overlapping and touching spans are one run; empty ones are left out.
    """
    number, flat = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy()), spans.flatten()
    lo, hi = (np.concatenate([flat.field(f[i]).to_numpy().astype(np.int64) for f in fields]) for i in (0, 1))
    some = np.flatnonzero(lo < hi)
    own, lo, hi = np.tile(number, len(fields))[some], lo[some], hi[some]
    order = np.lexsort((lo, own))
    own, lo, hi = own[order], lo[order], hi[order]
    base = own * (hi.max(initial=0) + 1)  # runs of two texts never touch
    top = np.maximum.accumulate(hi + base)
    heads = np.flatnonzero(np.append(True, lo[1:] + base[1:] > top[:-1])) if len(own) else own
    ends = np.append(heads[1:], len(own))[: len(heads)] - 1
    return own[heads], lo[heads], top[ends] - base[ends]


def kept(texts: list[bytes], own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
    """The texts without the given runs."""
    left = list(texts)
    heads = _heads(own).tolist()
    for a, b in zip(heads, [*heads[1:], len(own)]):
        text = texts[own[a]]
        bounds = [0, *np.column_stack((lo[a:b], hi[a:b])).ravel().tolist(), len(text)]
        left[own[a]] = b"".join([text[x:y] for x, y in zip(bounds[::2], bounds[1::2])])
    return left


def _with_spans(docs: DataFrame, *windows: int) -> DataFrame:
    """``docs`` and __r_spans; its columns may have any names but those that begin with __r_."""
    spans = repeated_spans(docs.select("doc_id", text_key().alias("text_key"), "text"), *windows)
    keys, few = _keys(spans)
    spans = spans.select(F.col("doc_id").alias("__r_id"), F.col("text_key").alias("__r_key"), F.col("spans").alias("__r_spans"))
    whole = docs.withColumn("__r_own", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("__r_id")) & (F.col("__r_own") == F.col("__r_key"))
    if not few:
        return whole.join(spans, same, "left").select(*docs.columns, "__r_spans")
    keys = F.broadcast(keys.toDF("__r_kid", "__r_kkey"))  # texts without spans need not be shuffled
    mine = F.col("doc_id").eqNullSafe(F.col("__r_kid")) & (F.col("__r_own") == F.col("__r_kkey"))
    clean = whole.join(keys, mine, "left_anti").select(*docs.columns, F.lit(None).cast(spans.schema["__r_spans"].dataType).alias("__r_spans"))
    return clean.union(whole.join(keys, mine, "left_semi").join(spans, same).select(*docs.columns, "__r_spans"))


def op10(docs: DataFrame, length: int = LENGTH, words: int = WORDS, least: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row, by windows of ``length`` bytes; then n_passages and
    passage_bytes: the runs of its text that passages cover and their bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _with_spans(docs.select("doc_id", "text"), length, words, least).select("doc_id", "text", "__r_spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, n = _texts(batch.column(1)), batch.num_rows
            own, lo, hi = merged(batch.column(2), ("lo", "hi"))
            words_own, words_lo, words_hi = merged(batch.column(2), ("words_lo", "words_hi"))
            columns = [
                [len(t) for t in texts], np.bincount(own, hi - lo, n).astype(np.int64), np.bincount(own, minlength=n),
                [hashlib.sha256(t).hexdigest() for t in kept(texts, own, lo, hi)],
                np.bincount(words_own, minlength=n), np.bincount(words_own, words_hi - words_lo, n).astype(np.int64),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_bytes long")


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = WORDS, least: int = PASSAGE) -> DataFrame:
    """``docs`` with every repeated window and passage cut out of text; a character that is cut in part goes. Documents of which nothing is left go."""

    at, columns = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            own, lo, hi = merged(batch.column(len(columns)), ("lo", "hi"), ("words_lo", "words_hi"))
            cut = np.unique(own).tolist()
            number = np.searchsorted(cut, own) if cut else own
            stay = np.ones(len(texts), dtype=bool)
            for i, left in zip(cut, kept([texts[i].encode() for i in cut], number, lo, hi)):
                texts[i] = left.decode("utf-8", "ignore")
                stay[i] = texts[i] != ""
            arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(stay, pa.bool_()))

    return _with_spans(docs, length, words, least).select(*columns, "__r_spans").mapInArrow(run, docs.schema)
