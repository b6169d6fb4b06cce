"""A corpus from raw documents to packed sequences: five stages, each on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again before the next
one starts. All but the last return the columns of ``documents``. A stage begins by removing the tables that earlier
ones left in the shared folder, unless its documents still read them.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontaminate import drop_leaks
from gridloom.llm.line_dedup import line_dedup
from gridloom.llm.ngram_join import drop_near_copies
from gridloom.llm.packing import pack
from gridloom.llm.toxicity import drop_toxic, train
from gridloom.plans.shared import remove, scratch, shared_root

#: Near-duplicates: five-word shingles with a similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY = 5, Fraction(4, 5)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models do not call toxic.

    A null or empty text is judged like one of unknown words. Repeated rows share one fate. An empty table gives an
    empty one; without labels nothing goes. Columns with clashing names pass through.
    """
    with scratch(docs):
        models = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5, held=0)
        return drop_toxic(docs, models)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines; n_chars follows the text.

    A null text stays null, and its n_chars too; a null source is a source of its own. Repeated rows count as pages
    of their own and stay. An empty table gives an empty one.
    """
    with scratch(docs):
        return line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, once if its row is repeated.

    Wordless documents, null and empty texts among them, are nobody's duplicates and all stay. Of a group without
    ids one stays. An empty table gives an empty one. Columns with clashing names pass through.
    """
    with scratch(docs):
        return drop_near_copies(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; null and blank items are held by none. Repeated rows share one fate. An empty
    table gives an empty one, an empty benchmark all rows. Columns with clashing names pass through.
    """
    with scratch(docs):
        return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences.

    A null or empty text is one token. Repeated rows are packed each, a null doc_id stays null. An empty table gives
    no pieces. Extra columns are ignored.
    """
    import public_tokenizers

    with scratch(docs):
        return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line dedup", line_deduplication), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Trained models and packing are beyond SQL. tests/llm holds every stage and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again.

    What a stage read goes when the next one's documents have been written. Cases are those of the stages.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_root(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
