import hashlib
import random
import re
from collections import Counter

import numpy as np

from arborlake.llm import repeats


def brute(texts, length):
    return cut([[(p, p + length) for p in range(len(t) - length + 1)] for t in texts], texts)


def passages(text, words, least):
    found = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    for i, (a, _) in enumerate(found):
        for b in (b for _, b in found[i + words - 1 :]):
            if b - a >= least:
                yield a, b
                break


def cut(windows, texts):
    seen = Counter(t[a:b] for t, w in zip(texts, windows) for a, b in w)
    out = []
    for t, w in zip(texts, windows):
        mask = bytearray(len(t))
        for a, b in w:
            if seen[t[a:b]] > 1:
                mask[a:b] = b"\1" * (b - a)
        left = bytes(c for c, m in zip(t, mask) if not m)
        runs = sum(1 for i, m in enumerate(mask) if m and (i == 0 or not mask[i - 1]))
        out.append((len(t), len(t) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    passages = ["".join(word() for _ in range(rnd.randint(3, 60))) for _ in range(12)]
    texts = ["".join(rnd.choice([word(), word(), word(), rnd.choice(passages)]) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts += [texts[0], texts[0][:200], texts[1][5:], "ab" * 300, "x" * 500, "x" * 40, "x" * 39, "", "short", texts[2][:90] + "!" + texts[2][90:]]
    return texts


def test_against_brute_force(spark, documents):
    for length in (40, 57, 400):
        texts = [t.encode() for t in corpus(length)]
        docs = documents([(i, t.decode()) for i, t in enumerate(texts)])
        for words, least in ((51, 256), (3, 41)):
            got = {r["doc_id"]: tuple(r[1:]) for r in repeats.op10(docs, length, words, least).collect()}
            assert [got[i][:4] for i in range(len(texts))] == brute(texts, length)
            want = cut([list(passages(t, words, least)) for t in texts], texts)
            assert [got[i][4:] for i in range(len(texts))] == [(w[2], w[1]) for w in want]


def test_many_texts_are_shuffled(spark, documents, monkeypatch):
    monkeypatch.setattr(repeats, "FEW", 0)
    texts = [t.encode() for t in corpus(40)]
    got = {r["doc_id"]: tuple(r[1:5]) for r in repeats.op10(documents([(i, t.decode()) for i, t in enumerate(texts)]), 40).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 40)


def test_nulls_and_repeated_rows(spark, documents):
    long = "".join(chr(97 + i * i % 26) for i in range(500))
    rows = [(1, None), (None, long), (3, long + "tail"), (4, "q" + long[1:]), (4, "q" + long[1:])]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in repeats.op10(documents(rows)).collect())
    assert got == [("1", 0, 0), ("3", 504, 500), ("4", 500, 500), ("4", 500, 500), ("None", 500, 500)]


def test_documents_without_repeats(spark, documents):
    passage = "é" + "".join(chr(97 + (i * 7 + i // 26) % 26) for i in range(420))
    docs = documents([(1, "begin " + passage + " end"), (2, "other " + passage), (3, passage), (4, "clean"), (5, None), (6, "")])
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "begin end", 2: "other", 4: "clean", 5: None, 6: ""}


def test_empty(spark, documents):
    assert repeats.op10(documents([])).count() == 0
    assert repeats.without_repeats(documents([])).count() == 0


def test_samples_do_not_depend_on_what_is_outside():
    rnd = random.Random(9)
    data = bytes(rnd.randrange(97, 103) for _ in range(3000))
    step, width = repeats.sampling(256)
    assert width >= step
    whole = repeats.samples(data, step)
    for p in range(0, 2600, 37):
        assert whole[p] == p + repeats.samples(data[p : p + 256], step)[0] and p <= whole[p] < p + step


def test_the_transform_sorts_and_walks():
    rnd = np.random.default_rng(5)
    for texts in ([5, 9, 1], [1], [30, 30, 2]):
        own = np.repeat(np.arange(len(texts)), texts)
        letter = rnd.integers(0, 3, len(own)).astype(np.uint64)
        if texts[0] == texts[1 % len(texts)]:
            letter[: texts[0]] = letter[texts[0] : 2 * texts[0]] if len(texts) > 1 else letter
        t = repeats.Transform(letter, own)
        tail = [tuple(letter[i : np.flatnonzero(own == own[i])[-1] + 1]) for i in range(len(own))]
        assert [tail[i] for i in t.suffixes] == sorted(tail)
        symbol = rnd.integers(0, 2**63, len(own)).astype(np.uint64)
        ask = [(i, h) for i in range(len(own)) for h in range(1, len(tail[i]) + 1)]
        got = t.prefixes(symbol, np.array([i for i, _ in ask]), np.array([h for _, h in ask]))
        for (i, h), d in zip(ask, got):
            want = symbol[i + h - 1 : i + h]
            for j in range(i + h - 2, i - 1, -1):
                want = repeats.mixed(letter[j : j + 1], want)
            assert d == want[0]


def test_long_and_hot_texts(spark, documents):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(60_000))
    rows = [(0, long), (1, long[1000:] + " end"), (2, "x" * 70_000)] + [(10 + i, f"{word()} {i} {passage} {word()}") for i in range(300)] + [(500, passage)] * 40
    texts = [t.encode() for _, t in rows]
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["n_passages"], r["passage_bytes"]) for r in repeats.op10(documents(rows)).collect())
    words = cut([list(passages(t, 51, 256)) for t in texts], texts)
    assert got == sorted((i, *b[:3], w[2], w[1]) for (i, _), b, w in zip(rows, brute(texts, 400), words))


def test_passages_of_over_fifty_words_go(spark, documents):
    """51 words of about 300 bytes, too short for the byte windows; 50 words stay."""
    of = lambda n: " ".join("w%04d" % (i * 37 % 9973) for i in range(n))
    docs = documents([(1, "begin here " + of(51) + " and end"), (2, of(51)), (3, "q%s" % of(50).replace("w", "v")), (4, of(50).replace("w", "v")), (5, "clean text")])
    got = {r["doc_id"]: (r["n_removed"], r["n_passages"]) for r in repeats.op10(docs).collect()}
    assert got == {1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0), 5: (0, 0)}
    assert {r["doc_id"]: r["text"] for r in repeats.without_repeats(docs).collect()}[1] == "begin here  and end"
    assert repeats.without_repeats(docs).where("doc_id = 2").count() == 0
