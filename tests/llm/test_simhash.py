import random
import re

import numpy as np
import xxhash

from arborlake.llm import simhash
from arborlake.llm.components import connected_components


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def slow_components(prints):
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def corpus(n=160, seed=3):
    rnd = random.Random(seed)
    texts = []
    for i in range(n):
        if i % 4 and texts:
            words = texts[rnd.randrange(len(texts))].split(" ")
            if len(words) > 30:
                words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join("W%d" % rnd.randrange(900) for _ in range(rnd.randrange(1, 300))))
    return texts + ["", None, " \t\n", "One two", "ONE TWO", "É é\x1f a\x0bb"]


def test_against_brute_force(spark, documents):
    texts = corpus()
    prints = [slow_fingerprint(t) for t in texts]
    top = slow_components(prints)
    got = {r["doc_id"]: r for r in simhash.op7(documents(list(enumerate(texts)))).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {i: r["component_id"] for i, r in got.items()} == dict(enumerate(top))


def test_tiles_give_the_same_links(spark):
    rnd = np.random.default_rng(1)
    base = rnd.integers(-(2**62), 2**62, 40)
    values = np.unique(np.concatenate([base ^ (1 << b) for b in range(20)]))
    df = spark.createDataFrame([(int(v),) for v in values], "fp long")
    roots = [{r["node"]: r["root"] for r in connected_components(simhash.fingerprint_links(df, len(values), tile=t)).collect()} for t in (5, 512)]
    assert roots[0] == roots[1] and len(roots[0]) > 500


def test_pivots_make_fewer_pairs_and_lose_none():
    rnd = np.random.default_rng(8)
    values = rnd.integers(0, 2**64, 300, dtype=np.uint64)
    values[1::3] = values[::3] ^ (np.uint64(1) << rnd.integers(0, 64, 100).astype(np.uint64))
    table = np.bitwise_count(values[:, None] ^ simhash.references()[None, :]).astype(np.int8)
    near = lambda a, b: {(min(i, j), max(i, j)) for i in a for j in b if i != j and int(values[i] ^ values[j]).bit_count() <= 4}
    a, b = np.arange(0, 140), np.arange(140, 300)
    for left, right, most in ((np.arange(300), None, 300 * 299 // 2), (a, b, len(a) * len(b))):
        i, j = simhash.candidates(table, left, right, 4)
        made = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
        assert len(made) == len(i) < 0.75 * most
        assert near(left, left if right is None else right) <= made


def test_masks_cover_all_close_pairs():
    rnd = np.random.default_rng(2)
    for count in (10, 10**8, 10**11):
        masks = simhash.block_keys(count)
        for _ in range(300):
            flips = sum(1 << int(b) for b in rnd.choice(64, 4, replace=False))
            assert any(flips & m == 0 for m in masks)


def test_one_of_each_keeps_columns_and_single_rows(spark, documents):
    docs = documents([(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (None, "a b c d e"), (3, "something else is here now"), (None, "only null id")])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "3", "None"]


def test_one_of_each_keeps_a_row_of_every_component(spark, documents):
    rnd = random.Random(5)
    texts = [" ".join("w%d" % rnd.randrange(9000) for _ in range(60)) for _ in range(5)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (2, texts[3]), (None, texts[4]), (7, texts[4])]
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(documents(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (7, texts[4])], key=str)


def test_empty(spark, documents):
    assert simhash.op7(documents([])).count() == 0
    assert simhash.one_of_each(documents([])).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5000, 5000), (None, 3), (70, 70)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}}
