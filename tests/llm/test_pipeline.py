import importlib
import math
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from spidex.llm import mixing, packing, quality

from .test_dedup import naive_lines
from .test_simhash import naive_groups


def test_stages(spark, tmp_path):
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"file://{tmp_path}/{k}")
        docs, earlier = spark.read.parquet(f"file://{tmp_path}/{k}"), docs
        if name == "line_dedup":
            assert docs.count() == before and not docs.select("doc_id", "text").exceptAll(earlier.select("doc_id", "text")).isEmpty()
        elif name != "best_fit_packing" and name != "source_mixing":
            assert docs.count() < before
        if name != "best_fit_packing":
            assert docs.columns == columns
        before = docs.count()
    pieces, copies = docs, earlier
    assert pieces.filter("piece = 0").count() == copies.count()
    assert sorted(map(tuple, pieces.select("doc_id", "piece", "start", "length").collect())) == sorted(map(tuple, pipeline.run(spark, small).select("doc_id", "piece", "start", "length").collect()))


def test_short_lines_between_others_go(spark):
    docs = spark.createDataFrame([(k, f"only in {k}\nshare this page\nalso only in {k}") for k in range(4)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pipeline.line_dedup(spark, docs, "").collect()}
    assert out == {k: f"only in {k}\nshare this page\nalso only in {k}" if k == 0 else f"only in {k}\nalso only in {k}" for k in range(4)}


def test_entry_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("spidex.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "spidex.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.import_module("__spark_entry__")
    assert e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


OURS = "_rejected _gone _doc _places _key _copy _nth _id _row _kept _spans _source _size _tie _copies _to h doc at label node size score row print tie range rate unit first n".split()


def test_columns_of_any_name_are_kept(spark, odd_docs):
    """Columns that are called as those that a stage makes for itself."""
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"mine {k}").alias(c) for k, c in enumerate(OURS)))
    labels = spark.createDataFrame([(6, 1, 0), (4, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for stage in (lambda d: quality.kept_documents(d, labels), lambda d: pipeline.line_dedup(spark, d, ""), lambda d: pipeline.simhash_near_dedup(spark, d, ""), lambda d: pipeline.source_mixing(spark, d, "")):
        out = stage(docs)
        assert out.schema.names == docs.schema.names
        rows = out.collect()
        assert rows and all(r[c] == f"mine {k}" for r in rows for k, c in enumerate(OURS))
    assert packing.pack(docs, pipeline.tokenizer_path()).count() >= docs.count()


def naive_quality(docs, labels, odds):
    """{doc_id: kept}: posteriors by plain sums over lists."""
    judged = {}
    for d, q, t in labels:
        judged[d] = max(judged.get(d, 0), int(q == 0 or t == 1))
    paths = {}
    for d, _, source, lang in docs:
        if d in judged:
            paths.setdefault((source, lang), []).append(judged[d])
    every = [x for v in paths.values() for x in v]
    rate = (sum(every) + 0.5) / (len(every) + 1)

    def strength(groups):
        """groups [(bad, n, mean above)]."""
        groups = [g for g in groups if g[1] > 1]
        if not groups:
            return 100.0
        spread, chance = sum((b / n - m) ** 2 * n for b, n, m in groups), sum(m * (1 - m) for _, _, m in groups)
        between, mean = max(0.0, spread - chance) / sum(n for _, n, _ in groups), chance / len(groups)
        return min(1e6, max(1.0, mean / between - 1)) if between > 0 and mean > 0 else 1e6

    hosts = {}
    for (s, _), v in paths.items():
        hosts.setdefault(s, []).extend(v)
    k = strength([(sum(v), len(v), rate) for v in hosts.values()])
    host_rate = {s: (sum(v) + k * rate) / (len(v) + k) for s, v in hosts.items()}
    k = strength([(sum(v), len(v), host_rate[s]) for (s, _), v in paths.items()])
    prior = {p: (sum(v) + k * host_rate[p[0]]) / (len(v) + k) for p, v in paths.items()}
    out = {}
    for d, text, source, lang in docs:
        p = prior.get((source, lang), rate)
        logit = math.log(p / (1 - p)) + sum(odds[quality.features((text or "").encode())])
        out[d] = 1 / (1 + math.exp(-logit)) <= 0.9
    return out


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    naive = naive_quality(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()], quality.word_odds(docs, labels).astype(np.float32).astype(float))
    docs = pipeline.quality_classifier(spark, docs, small).cache()
    assert {r.doc_id for r in docs.collect()} == {d for d, kept in naive.items() if kept}
    naive = naive_lines([(r.doc_id, r.text or "") for r in docs.collect()], 1, 20)
    docs = pipeline.line_dedup(spark, docs, small).cache()
    assert {r.doc_id: r.text or "" for r in docs.collect()} == {d: t for (d, _), t in naive.items()}
    ordered = sorted((r.doc_id, r.text or "") for r in docs.collect())
    first = naive_groups([t for _, t in ordered])
    docs = pipeline.simhash_near_dedup(spark, docs, small).cache()
    assert {r.doc_id for r in docs.collect()} == {ordered[k][0] for k in set(first)} and docs.count() == len(set(first))
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    docs = pipeline.source_mixing(spark, docs, small).cache()
    assert Counter(r.doc_id for r in docs.collect()) == Counter({d: n for d, n in copies.items() if n})
    pieces = pipeline.best_fit_packing(spark, docs, small).collect()
    tokens = Tokenizer.from_file(pipeline.tokenizer_path())
    lengths = {d: len(tokens.encode(texts[d] or "", add_special_tokens=False).ids) + 1 for d in copies if copies[d]}
    taken, used = Counter(), {}
    for r in pieces:
        taken[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert taken == Counter({d: n * copies[d] for d, n in lengths.items()})
    for spans in used.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048


def test_one_row_of_each_group_stays(spark):
    same = "one text of more than five words"
    rows = [(3, same, "a"), (1, same, "b"), (1, same, "b"), (1, "some other text with more than five words", "c"), (None, same, "d"), (None, "a text without a number that is kept", "e"), (None, "a text without a number that is kept", "e"), (5, None, "f"), (4, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = sorted((str(r.doc_id), r.tag) for r in pipeline.simhash_near_dedup(spark, docs, "").collect())
    assert kept == [("1", "b"), ("1", "c"), ("4", "g"), ("None", "e")]
