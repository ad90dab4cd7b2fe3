import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spidex.llm import packing, queries, tokenbin
from spidex.llm.tokens import Encoder, batches

from .conftest import texts_of


def test_encoder_is_the_library(tokenizer):
    rng, enc = random.Random(3), Encoder(queries.tokenizer_path(), kept_ids=500)
    parts = [*"ab'stmdrevl  \n\t0é½. !  x12ßΩ中🙂́", "'s", "'re", "'ll", " '", "  ", "\n\n", "<|endoftext|>", " ", "\x1c"]
    texts = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000))]
    for a, b in batches(texts, 5000):
        ids, bounds = enc.encode(texts[a:b])
        for k in range(a, b):
            assert ids[bounds[k - a] : bounds[k - a + 1]].tolist() == tokenizer.encode(texts[k], add_special_tokens=False).ids, texts[k]


@settings(deadline=None)
@given(st.integers(1, 20), st.data())
def test_bits(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=200)), np.uint32)
    packed = tokenbin.pack_bits(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8
    first = data.draw(st.integers(0, len(ids)))
    count = data.draw(st.integers(0, len(ids) - first))
    assert tokenbin.unpack_bits(packed, bits, first, count).tolist() == ids[first : first + count].tolist()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_binary_query(spark, small, small_texts, tokenizer):
    rows, start = {r.doc_id: r for r in queries.op5_token_binary(spark, small).collect()}, 0
    for d in sorted(small_texts):
        ids = [*tokenizer.encode(small_texts[d], add_special_tokens=False).ids, 2]
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert rows.keys() == small_texts.keys()


def test_token_files(spark, odd_docs, no_docs, tokenizer, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        path = f"file://{tmp_path}/{name}"
        tokenbin.write(docs, path, queries.tokenizer_path(), block_ids=100)
        blocks = tokenbin.read(spark, path)
        got = tokenbin.decoded(blocks, with_ids=True).orderBy("start").collect()
        expected = sorted(((d, [*tokenizer.encode(t, add_special_tokens=False).ids, 2]) for d, t in texts_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0))
        assert [(r.doc_id, list(r.ids)) for r in got] == expected
        assert all(r.bits == 16 for r in blocks.select("bits").collect())


def naive_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [k for k in range(len(bins)) if bins[k] >= s]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_plan_is_best_fit_decreasing(capacity, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=120))
    counts = Counter(sizes)
    moves, bins = packing.plan(counts, capacity)
    used, nth = defaultdict(list), Counter()
    for length, rank, n, each, first, offset in moves.tolist():
        assert rank == nth[length]
        nth[length] += n
        for k in range(n):
            used[first + k // each].append((offset + k % each * length, length))
    assert nth == counts and len(used) == bins
    for placed in used.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in p) for p in used.values()) == naive_best_fit(sizes, capacity)
    assert len(moves) <= 200 * capacity


def check_packed(rows, docs, tokenizer, capacity, end_id):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for d, copies in Counter(docs).items():
        ids = [*tokenizer.encode(d[1], add_special_tokens=False).ids, end_id]
        mine = sorted(by_doc[d[0]], key=lambda r: r.piece)
        assert sum(r.length for r in mine) == copies * len(ids) if len({t for i, t in docs if i == d[0]}) == 1 else True
        for r in mine:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        starts = [r.start for r in mine][::copies]
        assert starts == [0, *range((len(ids) - 1) % capacity + 1, len(ids), capacity)]
    assert len(by_doc) == len({d for d, _ in docs})


def test_packing_query(spark, small, small_texts, tokenizer):
    rows = queries.op1_best_fit_packing(spark, small).collect()
    check_packed(rows, sorted(small_texts.items()), tokenizer, 2048, 0)
    assert len({r.sequence_id for r in rows}) == len(naive_best_fit([r.length for r in rows], 2048))


def test_packing_odd(spark, odd_docs, no_docs, tokenizer):
    path = queries.tokenizer_path()
    packed = packing.pack(odd_docs, path, capacity=64, with_ids=True)
    check_packed(packed.collect(), texts_of(odd_docs), tokenizer, 64, 0)
    for s in packing.sequences(packed).collect():
        assert 0 < len(s.ids) <= 64
    assert packing.pack(no_docs, path).count() == 0
