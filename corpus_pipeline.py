"""From raw documents to packed sequences: each stage takes what its predecessor kept, and its decisions take effect.

All stages but the last return the columns of documents. A stage may be given any table with these columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrylog.llm import decontaminate, lines, packing, quality, simhash
from quarrylog.llm.common import Scratch
from quarrylog.llm.queries import TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more, learnt from labelled documents of this stage's input.

    Null and empty texts are scored as texts without words. Null or repeated doc_ids are scored row by row, and rows of one score stay or
    go alike. An empty table, or one without labelled rows, gives no rows, as everything scores 0.5 then. Other columns stay and are never read.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more documents have.

    All rows stay, a text may become empty, and null texts stay null. Repeated rows and doc_ids count as documents of their own. An empty
    table gives no rows.
    """
    return lines.drop_frequent_lines(docs, min_docs=10)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that is alike to 0.8 or more on shingles of five words.

    Documents without words and rows with a null doc_id stay; repeated rows of a doc_id stay or go together. An empty table gives no rows.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are benchmark items to a twentieth or more, and without such passages of the others.

    Null and empty texts, and all rows if there are no items, stay as they are. Rows are judged one by one. An empty table gives no rows.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in sequences of 2048 tokens.

    Null and empty texts are the end token alone. Repeated rows make pieces of their own; null doc_ids stay null. An empty table
    gives no rows.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("packing", pack_tokens),
]

#: SQL expresses none of the classifier, the wide fingerprints and the tokenizer; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again as the next one's documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
