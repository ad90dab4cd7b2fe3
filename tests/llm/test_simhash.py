import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from spidex.llm import queries, simhash
from spidex.llm.common import components

from .conftest import WORDS, texts_of


def naive_print(text, k=3):
    w = [bytes(x) for x in text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(rows, distance=3):
    """rows [(id, fp)] -> {id: smallest reachable id}."""
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= distance:
                label[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), d), d)
    return [least[root(k)] for k in range(len(rows))]


@given(st.text(max_size=60))
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert simhash.fingerprint(text) == naive_print(text)


@settings(max_examples=300)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_no_pair_is_lost(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f
    mask = 2**64 - 1

    def keys(x):
        out = set()
        for i in range(8):
            t = (x << 8 * i | x >> (64 - 8 * i)) & mask
            for k, part in enumerate((t >> 36 & 0xFFF, t >> 24 & 0xFFF)):
                out.add((2 * i + k, t >> 48, part))
        return out

    # some shared key from whose start every chain is within its budget
    ok = False
    for slot, _, _ in keys(a) & keys(b):
        i = slot // 2
        t = ((a ^ b) << 8 * i | (a ^ b) >> (64 - 8 * i)) & mask
        ok |= all(bin(t >> (64 - 8 * l)).count("1") <= l * 3 // 8 for l in range(1, 9))
    assert ok


def link_nodes(spark, fps, **how):
    rows = [(int(np.uint64(f).astype(np.int64)), k) for k, f in enumerate(fps)]
    found = components(simhash.links(spark.createDataFrame(rows, "fp long, node long"), **how))
    label = {r.node: r.label for r in found.collect()}
    return [label.get(k, k) for k in range(len(fps))]


@pytest.mark.parametrize("block", [4096, 7])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    fps = set()
    while len(fps) < 400:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 5, 60])):  # chains and clusters
            fps.add(f)
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    assert link_nodes(spark, fps) == naive_components([(k, f) for k, f in enumerate(fps)])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(200, 100), (300, 100), (5, 5)], "a long, b long").repartition(4)
    assert {r.node: r.label for r in components(edges).collect()} == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 100}
    assert components(edges.limit(0)).count() == 0


def test_query(spark, small, small_texts):
    rows = queries.op8_simhash_near_dedup(spark, small).orderBy("doc_id").collect()
    prints = [(d, naive_print(t)) for d, t in sorted(small_texts.items())]
    assert [(r.doc_id, r.fingerprint) for r in rows] == [(d, f"{p:016x}") for d, p in prints]
    assert [r.component_id for r in rows] == naive_components(prints)


def test_odd(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).withColumn("hex", simhash.hex_digits()).collect()
    assert sorted((str(r.doc_id), r.hex) for r in rows) == sorted((str(d), f"{naive_print(t):016x}") for d, t in texts_of(odd_docs))
    of = {r.doc_id: r.component_id for r in rows}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == 4 and of[7] == 6 and of[None] is None
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.similar_groups(no_docs).count() == 0
    kept = simhash.one_of_each(odd_docs)
    assert kept.schema == odd_docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "8", "9", "None"]


def jaccard(a, b, k=5):
    x, y = ({tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_groups(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [rng.choice(WORDS) + str(rng.randrange(500)) for _ in range(300)]
        texts.append(" ".join(base))
        for edits in (1, 3, 150):
            copy = list(base)
            for p in rng.sample(range(300), edits):
                copy[p] = "edit" + str(rng.randrange(10**6))
            texts.append(" ".join(copy))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, fp string")
    of = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    for b in range(0, 240, 4):
        assert jaccard(texts[b], texts[b + 2]) > 0.85 and jaccard(texts[b], texts[b + 3]) < 0.3
        assert [of[b + k] for k in range(4)] == [b, b, b, b + 3]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in range(240) if k % 4 in (0, 3)}


def naive_groups(texts, similarity=0.8):
    """[text] -> index of the first text reachable over pairs whose Jaccard similarity reaches ``similarity``."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (t.lower().split() for t in texts)]
    label = list(range(len(texts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * 1000 >= round(similarity * 1000) * len(sets[i] | sets[j]):
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [root(k) for k in range(len(texts))]


@pytest.mark.parametrize(("block", "weight"), [(4096, 1 << 21), (5, 600)])
def test_similar_groups_near_the_threshold(spark, monkeypatch, block, weight):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHINGLES", weight)
    rng = random.Random(8)
    texts, seen = ["", "one", "one", "one two", " \t"], []
    for size in [184] * 100 + [8, 10, 12, 14] * 40:
        base = [rng.choice(WORDS) + str(rng.randrange(10**5)) for _ in range(size)]
        # words cut at the end: j of size - 4 shingles are left
        for similarity in (rng.uniform(0.6, 0.9), 0.8):
            left = max(1, round(similarity * (size - 4)))
            texts += [" ".join(base), " ".join(base[: left + 4])]
            seen.append(left / (size - 4))
    for hub in range(4):  # many texts around one passage, most of them unlike each other
        passage = [rng.choice(WORDS) + str(rng.randrange(10**5)) for _ in range(60)]
        texts += [" ".join(passage + [f"t{rng.randrange(10**6)}" for _ in range(rng.choice([5, 8, 30]))]) for _ in range(30)]
    assert min(seen) < 0.62 and max(seen) > 0.88 and sum(0.79 < x < 0.81 for x in seen) > 50
    order = list(range(len(texts)))
    docs = spark.createDataFrame([(k, texts[k]) for k in order], "doc_id long, text string").repartition(3)
    of = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert [of[k] for k in order] == naive_groups(texts)
