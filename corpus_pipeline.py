"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame whose result is written and read again as the next one's ``docs``. All but
the last return the columns of ``documents``:

1. quality_classifier: documents that the classifier rejects go.
2. line_dedup: repeated lines, alone or in runs, go from all but their first place.
3. simhash_near_dedup: of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.
4. source_mixing: a document comes as often as the mix of sources takes it (0, 1 or 2 rows).
5. best_fit_packing: one row for each piece of each copy, with its sequence and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spidex.llm import linededup, mixing, packing, quality, simhash
from spidex.llm.common import documents, labels, scratch
from spidex.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs, min_lines=1)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [(f.__name__, f) for f in (quality_classifier, line_dedup, simhash_near_dedup, source_mixing, best_fit_packing)]

#: Fingerprints, the network of weights and the packing order have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    from spidex.llm.common import cut

    docs = documents(spark, sf_dir)
    with scratch(spark) as path:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(path(name))
            docs = spark.read.parquet(path(name))
        return cut(STAGES[-1][1](spark, docs, sf_dir))
