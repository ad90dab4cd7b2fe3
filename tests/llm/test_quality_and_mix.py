import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spidex.llm import langid, mixing, quality, queries, rules

from .conftest import WORDS, texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_base(text):
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def check_base(rows, texts):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    expected = []
    for d, t in texts:
        b = naive_base(t)
        expected.append((str(d), *b, b[0] < 50 or 100 * b[4] > 50 * b[0]))
    assert got == sorted(expected)
    assert not any(r.kept and r.base_failed for r in rows)


def test_rules_query(spark, small, small_texts):
    rows = queries.op6_quality_rules(spark, small).collect()
    check_base(rows, small_texts.items())
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    table, trusted = Counter(), Counter()
    for d, t in small_texts.items():
        g = rules.grams(np.frombuffer(t.encode(), np.uint8)).tolist()
        table.update(g)
        if d in labels and labels[d].quality == 1 and labels[d].toxic == 0:
            trusted.update(g)
    raw, good = (np.array([c[b] for b in range(rules.BUCKETS)], float) for c in (table, trusted))
    back = (raw + 0.5) / (raw + 0.5).sum()
    ratio = np.log((good + rules.BUCKETS * back) / (good.sum() + rules.BUCKETS)) - np.log(back)
    for r in rows:
        g = rules.grams(np.frombuffer(small_texts[r.doc_id].encode(), np.uint8))
        score = ratio[g].mean() if len(g) else 0
        assert r.score == pytest.approx(score, abs=1e-5)
        assert r.kept == (not r.base_failed and r.score >= -0.05)
    clean = [r for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1 and labels[r.doc_id].toxic == 0 and not r.base_failed]
    assert np.mean([r.kept for r in clean]) > 0.97


def test_rules_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(6, 1, 0, "x"), (None, 1, 0, "x"), (4, None, None, "x"), (6, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    check_base(rules.quality_rules(odd_docs, labels).collect(), texts_of(odd_docs))
    assert {r.score for r in rules.quality_rules(odd_docs, labels.limit(0)).collect()} == {0.0}
    assert rules.quality_rules(no_docs, labels).count() == 0


def test_rules_learn_from_every_trusted_text(spark):
    docs = spark.range(20_600).selectExpr("id as doc_id", "'t' || id as text")
    labels = docs.selectExpr("doc_id", "int(doc_id < 20500) as quality", "0 as toxic")
    raw, good = np.zeros(rules.BUCKETS), np.zeros(rules.BUCKETS)
    for k in range(20_600):
        g = rules.grams(np.frombuffer(f"t{k}".encode(), np.uint8))
        np.add.at(raw, g, 1)
        if k < 20_500:
            np.add.at(good, g, 1)
    back = (raw + 0.5) / (raw + 0.5).sum()
    assert np.allclose(rules.log_ratio(docs, labels), np.log((good + rules.BUCKETS * back) / (good.sum() + rules.BUCKETS)) - np.log(back), rtol=0, atol=1e-12)


def corpus(n=1600, seed=1):
    """Documents of which some hold insults or shout; labels say so for half."""
    rng, docs, labels = random.Random(seed), [], []
    for k in range(n):
        w = [rng.choice(WORDS) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.randint(20, 120))]
        bad = rng.random() < 0.25
        if bad and rng.random() < 0.5:
            w[rng.randrange(len(w))] = "Nasty" + rng.choice(["one", "two"])
        elif bad:
            w = [x.upper() + "!!" for x in w]
        docs.append((k, " ".join(w), "en", f"s{k % 7}", bad))
        if k % 2:
            labels.append((k, int(not bad), 0))
    return docs, labels


def test_classifier(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([d[:4] for d in docs], "doc_id long, text string, lang string, source string")
    lf = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.classify(df, lf).collect()}
    unseen = [d for d in docs if not d[0] % 2]
    assert len(kept) == len(docs) and np.mean([kept[d[0]] != d[4] for d in unseen]) > 0.97
    rest = quality.kept_documents(df, lf)
    assert rest.columns == df.columns and {r.doc_id for r in rest.collect()} == {d for d, k in kept.items() if k}


def test_site_priors(spark):
    sites = spark.createDataFrame([(k, "dirty" if k < 200 else "clean" if k < 400 else "rare", "en") for k in range(402)], "doc_id long, source string, lang string")
    labels = spark.createDataFrame([(k, int(k >= 160), 0) for k in range(400)] + [(400, 0, 0)], "doc_id long, quality int, toxic int")
    priors, rate = quality.site_priors(sites, labels)
    p = {r.s: r.prior for r in priors.collect()}
    assert rate == pytest.approx(161.5 / 402)
    assert p["dirty"] > 0.7 and p["clean"] < 0.05 and rate < p["rare"] < 0.8  # one label moves it, but not to 1


def test_classifier_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(6, 1, 0), (4, 0, None), (None, 0, 0), (5, None, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd_docs, labels).count() == odd_docs.count()
    assert all(r.kept for r in quality.classify(odd_docs, labels.limit(0)).collect())
    assert quality.classify(no_docs, labels).count() == 0
    assert quality.kept_documents(odd_docs, labels).schema == odd_docs.schema


def test_classifier_query(spark, small, small_texts):
    rows = queries.op10_quality_classifier(spark, small).collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert {r.doc_id for r in rows} == small_texts.keys()
    assert np.mean([r.kept for r in rows if r.doc_id in labels and labels[r.doc_id].quality == 1 and not labels[r.doc_id].toxic]) > 0.95


def naive_targets(sizes, share, weights):
    names = sorted(sizes)
    w, left, open_, out = {s: weights[k % 3] for k, s in enumerate(names)}, share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def test_mix_query(spark, small):
    rows = queries.op2_mix_sources(spark, small).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(WORD.findall(d.text)) and r.taken in (0, r.size, 2 * r.size)
        sizes[d.source] += r.size
        taken[d.source] += r.taken
        target[d.source] = (r.target, r.source_size)
    assert len(rows) == len(docs)
    for s, t in naive_targets(sizes, 1.5, mixing.WEIGHTS).items():
        assert target[s] == (pytest.approx(t), sizes[s]) and abs(taken[s] - t) <= max(0.02 * t, 5)
    again = queries.op2_mix_sources(spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_odd(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.copies <= 2 for r in rows)
    by_source = defaultdict(set)
    for r in rows:
        by_source[r.source_key].add((r.source_size, round(r.target, 6)))
    assert all(len(v) == 1 for v in by_source.values()) and "t" in by_source
    out = mixing.mixed_documents(odd_docs)
    assert out.schema.names == odd_docs.schema.names and out.count() == sum(r.copies for r in rows)
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_targets_cap(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 500, "e": 70}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source_key string, source_size long"), 1.5, (5, 2, 1)).collect()
    assert {r.source_key: r.target for r in rows} == pytest.approx(naive_targets(sizes, 1.5, (5, 2, 1)))


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Network(["x", "y", "z"], units=3)
    x, y = rng.integers(0, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    real = np.arange(7)[:, None] < np.array([7, 7, 3, 5, 7])[None]
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(x, y, real)
    for name in net.p:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in net.p[name].shape)
            at = (int(x[1, 1]), *at[1:]) if name[0] == "t" else at
            old, e = net.p[name][at], 1e-3
            net.p[name][at] = old + e
            up, _ = net.gradients(x, y, real)
            net.p[name][at] = old - e
            down, _ = net.gradients(x, y, real)
            net.p[name][at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * e), abs=2e-4)


def test_language_query(spark, small):
    import zlib

    rows = {r.doc_id: r for r in queries.op9_language_id(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert all(rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) for d in docs)
    apart = [d for d in docs if rows[d.doc_id].held_out]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in apart]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_odd(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs, steps=30).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count() and by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == "und" and by[1].score == 0
    assert by[6].lang_pred == by[7].lang_pred and {r.lang_pred for r in rows} <= {"und", "en", "de", "fr"}
    assert langid.identify(no_docs).count() == 0


def test_segments_cover_the_text():
    net = langid.Network(["x", "y"])
    text = bytes(range(1, 200))
    x, n = langid.segments(text)
    q, _ = net.forward(np.ascontiguousarray(x.T))
    whole = q.transpose(1, 0, 2).reshape(-1, 2)[:n].mean(axis=0)
    assert net.documents([b"", text, b"abc", text])[[1, 3]] == pytest.approx(np.array([whole, whole]), abs=1e-5)


def test_tilts_solve_the_dual(spark):
    """Against bisection of each source's own equation in plain Python."""
    rng = random.Random(3)
    histogram = [(s, size, rng.randint(1, 40)) for s in "abc" for size in rng.sample(range(1, 900), 60)]
    sizes = Counter()
    for s, size, n in histogram:
        sizes[s] += size * n
    wanted = {"a": 0.3 * sizes["a"], "b": 1.1 * sizes["b"], "c": 1.9 * sizes["c"]}
    sources = spark.createDataFrame([(s, sizes[s], wanted[s]) for s in "abc"], "source_key string, source_size long, target double")
    found = {r.source_key: r for r in mixing.tilts(spark.createDataFrame(histogram, "source_key string, size long, n long"), sources).collect()}
    for s in "abc":
        rows = [(size, n) for k, size, n in histogram if k == s]
        mean = sum(size * n for size, n in rows) / sum(n for _, n in rows)
        got = lambda tilt: sum(n * size * 2 / (1 + np.exp(-tilt * size / mean)) for size, n in rows)  # noqa: E731, B023
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if got((lo + hi) / 2) < wanted[s] else (lo, (lo + hi) / 2)
        assert found[s].mean == pytest.approx(mean) and found[s].tilt == pytest.approx(lo, rel=1e-4)


def test_mix_does_not_depend_on_how_rows_are_dealt(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert once == {r.doc_id: r.copies for r in mixing.mix(docs.orderBy("text").repartition(3)).collect()}


def test_network_against_plain_loops():
    """Each byte of a text by scalar arithmetic: both directions, within its segment."""
    rng = np.random.default_rng(5)
    net = langid.Network(["x", "y", "z"], units=3)
    soft = lambda v: v / (1 + abs(v))

    def states(data, table, u):
        h, out = [0.0] * 3, []
        for byte in data:
            a, new = table[byte], []
            m = [sum(h[i] * u[i][k] for i in range(3)) for k in range(9)]
            for j in range(3):
                z, r = soft(a[j] + m[j]) / 2 + 0.5, soft(a[3 + j] + m[3 + j]) / 2 + 0.5
                new.append(h[j] + z * (soft(a[6 + j] + r * m[6 + j]) - h[j]))
            h = new
            out.append(h)
        return out

    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (1, 63, 64, 65, 200)]
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    for text, got in zip(texts, net.documents(texts)):
        total = np.zeros(3)
        for a in range(0, len(text), langid.SEGMENT):
            part = text[a : a + langid.SEGMENT].ljust(langid.SEGMENT, b"\0")
            forward, backward = states(part, p["tf"], p["uf"]), states(part[::-1], p["tb"], p["ub"])[::-1]
            for f, b in list(zip(forward, backward))[: len(text) - a]:
                logits = [sum(x * p["v"][i][k] for i, x in enumerate(f + b)) + p["b"][k] for k in range(3)]
                e = np.exp(np.array(logits) - max(logits))
                total += e / e.sum()
        assert got == pytest.approx(total / len(text), abs=2e-5)
