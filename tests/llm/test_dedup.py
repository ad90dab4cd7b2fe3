import hashlib
import random

import duckdb
import numpy as np
import pytest

from spidex.llm import linededup, queries, suffix
from spidex.llm.common import scratch

from .conftest import WORDS, texts_of


def naive_bytes(docs, length):
    """[(id, bytes)] -> [(removed, spans, kept)], by every string of the length."""
    first = {}
    for d, t in docs:
        key = -1 if d is None else d
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for d, t in docs:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (-1 if d is None else d):
                gone[s : s + length] = b"\1" * length
        out.append((sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def check_bytes(rows, docs, length):
    assert len(rows) == len(docs)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert got == sorted((str(d), len(t), n, s, hashlib.sha256(k).hexdigest()) for (d, t), (n, s, k) in zip(docs, naive_bytes(docs, length)))


def test_suffix_query(spark, small, small_texts):
    rows = queries.op3_suffix_dedup(spark, small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    check_bytes(rows, [(d, t.encode()) for d, t in sorted(small_texts.items())], 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM ({suffix.ORACLE_SQL})").fetchall())


@pytest.mark.parametrize(("length", "gram", "batch"), [(12, 5, 300), (12, 12, 1), (8, 1, 100_000)])
def test_suffix_random(spark, monkeypatch, length, gram, batch):
    monkeypatch.setattr(suffix, "BATCH", batch)
    rng = random.Random(length * gram)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(30)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "ééé", "xyzxyzxyzxyz"]
    docs = [(rng.choice([k, k, k // 2]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for k in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check_bytes(suffix.repeated_bytes(df, length, gram).collect(), [(d, t.encode()) for d, t in docs], length)


@pytest.mark.parametrize("piece", [13, 64])
def test_suffix_in_pieces(spark, monkeypatch, piece):
    """Long texts are read in pieces, chunks are many, and compaction comes often; the result is the same."""
    monkeypatch.setattr(suffix, "PIECE", piece)
    monkeypatch.setattr(suffix, "HELD", 50)
    monkeypatch.setattr(suffix, "BATCH", 200)
    rng = random.Random(piece)
    parts = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(20)]
    docs = [(rng.choice([None, k, k]), "".join(rng.choice(parts) + rng.choice("xyz") * rng.randint(0, 3) for _ in range(rng.randint(0, 12)))) for k in range(80)]
    docs += docs[:5]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check_bytes(suffix.repeated_bytes(df, 12, 6, part_bytes=200, rounds=3).collect(), [(d, t.encode()) for d, t in docs], 12)


def test_difference_covers():
    for v in range(1, 70):
        cover = suffix.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and len(cover) <= 2 * v**0.5 + 2


def test_suffix_tables_in_any_order():
    """Lookups take a table as it comes and give its rows; orders hold where first bits, or all of the first key, agree."""
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 50, 5000):
        table = rng.permutation(np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)))
        keys = rng.permutation(np.concatenate([table, table ^ np.uint64(1 << 60), table + np.uint64(1 << 40)]))
        some, row = suffix._Lookup(table).find(keys)
        place = {k: i for i, k in enumerate(table.tolist())}
        assert list(zip(some.tolist(), row.tolist())) == [(i, place[k]) for i, k in enumerate(keys.tolist()) if k in place]
        for spread in (1, 3, 1 << 20, 1 << 64):
            first, second = rng.integers(0, spread - 1, n, dtype=np.uint64, endpoint=True), rng.integers(0, 3, n, dtype=np.uint64)
            first[: n // 2] |= np.uint64(1 << 63)
            assert suffix._sorted(first).tolist() == np.argsort(first, kind="stable").tolist()
            order = suffix._order(first, second)
            assert sorted(order.tolist()) == list(range(n)) and list(zip(first[order].tolist(), second[order].tolist())) == sorted(zip(first.tolist(), second.tolist()))


def test_suffix_second_hash_is_of_the_string_alone():
    """Equal strings have equal hashes wherever they are and whatever else is looked at; others differ."""
    rng = random.Random(3)
    part = [bytes(rng.choice(b"ab") for _ in range(rng.randint(60, 90))) for _ in range(4)]
    texts = [b"".join(rng.choice(part) for _ in range(5)) for _ in range(6)]
    sample = suffix.Sample([suffix.Piece(k, t, 0, len(t), 0, len(t)) for k, t in enumerate(texts)])
    own = np.flatnonzero(sample.own)
    strings = [sample.data[x : x + 50].tobytes() for x in own.tolist()]
    pairs = list(zip(*(h.tolist() for h in sample.suffixes(own))))
    assert len(set(pairs)) == len({p[1] for p in pairs}) == len(set(strings)) == len(set(zip(pairs, strings)))
    some = np.sort(np.array(rng.sample(range(len(own)), 40)))
    assert list(zip(*(h.tolist() for h in sample.suffixes(own[some])))) == [pairs[k] for k in some.tolist()]


def test_suffix_odd(spark, odd_docs, no_docs):
    rows = suffix.repeated_bytes(odd_docs).collect()
    docs = [(d, t.encode()) for d, t in texts_of(odd_docs)]
    by = {r.doc_id: r for r in rows}
    assert by[7].n_removed == by[7].n_bytes and [(s.start, s.length) for s in by[7].spans] == [(0, by[7].n_bytes)] and by[6].n_removed == 0
    assert len(rows) == len(docs) and by[1].n_bytes == 0 and by[None].n_removed == 0
    assert suffix.repeated_bytes(no_docs).count() == 0


def test_scratch_goes(spark):
    with scratch(spark) as path:
        spark.range(3).write.parquet(path("x"))
        assert spark.read.parquet(path("x")).count() == 3
        kept = path("x")
    assert not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept))


def naive_lines(docs, min_lines, long_words):
    """{(id, text): kept text}: by every window of lines and every long line, in order."""
    units, out = {}, {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = t.split("\n")
        real = [k for k, x in enumerate(lines) if x.encode().split()]
        gone = set()
        for a in range(len(real)):
            runs = [real[a : a + min_lines]] if a + min_lines <= len(real) else []
            if len(lines[real[a]].encode().split()) >= long_words:
                runs.append([real[a]])
            for run in runs:
                key = tuple(lines[k] for k in run)
                if units.setdefault(key, (d, t, run[0])) != (d, t, run[0]):
                    gone |= set(run)
        out[d, t] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_query_is_its_sql(spark, small, small_texts):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    rows = queries.op4_line_dedup(spark, small).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, kept_sha256 FROM ({linededup.ORACLE_SQL})").fetchall())
    naive = naive_lines(list(small_texts.items()), 2, 20)
    assert {r.doc_id: r.kept_sha256 for r in rows} == {d: hashlib.sha256(t.encode()).hexdigest() for (d, _), t in naive.items()}


@pytest.mark.parametrize(("min_lines", "long_words"), [(2, 4), (3, 99), (1, 99)])
def test_lines_random(spark, min_lines, long_words):
    rng = random.Random(min_lines)
    pool = [" ".join(rng.choices(WORDS, k=rng.randint(0, 5))) for _ in range(25)] + ["", " "]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for k in range(120)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in linededup.dedup_lines(df, min_lines, long_words).collect()}
    naive = naive_lines(docs, min_lines, long_words)
    assert {d: r.text for d, r in got.items()} == {d: t for (d, _), t in naive.items()}
    assert all(got[d].n_chars == (1 if naive[d, t] == t else len(naive[d, t])) for d, t in docs)


def test_lines_odd(spark, odd_docs, no_docs):
    out = linededup.dedup_lines(odd_docs)
    assert out.schema.names == odd_docs.schema.names and out.count() == odd_docs.count() and linededup.dedup_lines(no_docs).count() == 0
    by = {(r.doc_id, r.lang): r for r in out.collect()}
    assert by[1, None].text is None and by[9, "en"].text == "line one of text\nline two of text\n" and by[7, "de"].text == "" and by[7, "de"].n_chars == 0
    assert by[6, "en"].text and by[3, "en"].text == " \t\n\r\x0b\x0c "
