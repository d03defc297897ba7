import hashlib
import random

import pytest

from arborlake.llm import bpe, pretokens, token_counts

PIECES = ["'s", "'t", "'re", "'ll", " ", "  ", "\n", "\t", "a", "Z", "é", "ß", "1", "½", "!", "'", "\"", "-", "中", "𝔘", " ", "\x85", "\x1c", "\x00", "<|endoftext|>", "<|endof", "😀", "foo", "don't", "the", "\U0010ffff"]


def texts():
    rnd = random.Random(4)
    made = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    return made + [None, "", "a" * 5000, " " * 3000 + "x", "the quick brown fox " * 2000, "same", "same"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoding_and_decoding(spark, documents, library):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in bpe.encode_and_decode(documents(rows), keep=True).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == back
        assert r["ids_sha256"] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_counts(spark, documents, library):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in token_counts.op6(documents(rows)).collect()}
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)


def test_counts_of_every_prefix(library):
    for t in texts()[:60]:
        counts = token_counts.PrefixCounts(t)
        assert len(counts.counts) == len(t) + 1
        for i in range(len(t) + 1):
            assert counts.at(i) == len(library.encode(t[:i], add_special_tokens=False).ids)


def test_cut_uses_the_whole_budget(spark, documents, library):
    many = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    some = ["the quick brown fox jumps over the lazy dog " * 4, "a" * 60, "x \n\n y   'll don't", "", texts()[17], texts()[23]]
    for budget in (0, 1, 7, 17, 1000):
        got = {r["doc_id"]: r["text"] for r in token_counts.truncated(documents(list(enumerate(some)) + [(99, None)]), budget).collect()}
        assert got.pop(99) is None
        for i, t in enumerate(some):
            best = max(n for n in range(len(t) + 1) if many(t[:n]) <= budget)
            assert got[i] == t[:best]
            assert token_counts.PrefixCounts(t).total() == many(t)


def test_a_full_store_changes_nothing():
    some = texts()
    want = [x.tolist() for x in bpe.encode(some)]
    store = bpe.encoder()
    most, store.most = store.most, 10
    try:
        assert [x.tolist() for t in some for x in bpe.encode([t])] == want
    finally:
        store.most = most


def test_bytes_that_are_no_text():
    assert bpe.decode(next(bpe.encode(["é"]))[:1]) in ("é", "�")


def test_empty(spark, documents):
    assert bpe.op4(documents([])).count() == 0 and token_counts.op6(documents([])).count() == 0


def test_runs_of_equal_symbols_merge_from_the_left():
    """Words of one or two letters, where pairs overlap, against merging the least rank again and again."""
    vocab = bpe.vocabulary()
    draw = random.Random(4)
    words = [b"a" * n for n in range(1, 40)] + [b" " * n for n in range(1, 40)] + [bytes(draw.choice(b"aab ") for _ in range(draw.randint(1, 60))) for _ in range(300)]
    want = []
    for word in words:
        symbols = list(word)
        while ranks := [r for a, b in zip(symbols, symbols[1:]) if (r := vocab.merged.get(a << 17 | b)) is not None]:
            rank, out, i = min(ranks), [], 0
            while i < len(symbols):
                if tuple(symbols[i : i + 2]) == vocab.parts[rank]:
                    out.append(rank)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        want.append(symbols)
    got, counts = bpe.encode_words(words, vocab)
    assert got.tolist() == [x for w in want for x in w]
    assert counts.tolist() == [len(w) for w in want]
    assert bpe.encode_words([], vocab)[0].tolist() == []


def test_pre_tokens_whose_keys_meet_stay_apart(monkeypatch):
    kinds, one, two, width = pretokens._tables()
    monkeypatch.setattr(pretokens, "_tables", lambda: (kinds, one * 0, two, width))
    s = pretokens.split(["ab cd ab", "ef"], bpe.vocabulary().special)
    assert [s.words[i] for i in s.which] == ["ab", " cd", " ab", "ef"]
