"""The corpus pipeline: quality rules, near-copies, decontamination, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows
to the shared folder and gives what it reads back to the next. All but the last return the
columns of ``documents``.

Cases: null, empty and wordless texts fail the quality rules, so the later stages see them only
when called by themselves, and then keep them (near_copies, decontaminate), leave them as they are
(personal_data), or give them no ids (token_ids). Rows with a null doc_id go through every stage;
they are nobody's copy. Rows that share a doc_id share its fate among near copies. Of linked
documents the smallest doc_id stays, so there are no ties. An empty table stays empty. Columns
other than doc_id, text, lang and n_chars pass unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tissueloom.llm.bpe import encode_documents
from tissueloom.llm.common import staged
from tissueloom.llm.decontaminate import keep_clean
from tissueloom.llm.jaccard import keep_first
from tissueloom.llm.pii import redacted
from tissueloom.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; rows of one text and language share one verdict."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest doc_id.

    Near copies share 80 % of their shingles of five words; the query of operator 8 has its own contract.
    """
    return keep_first(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; one that holds an item goes as a whole."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    return redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with the digests of the ids and of their decoding."""
    return encode_documents(docs, keep_ids=True)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: The vocabularies, the field's weights and the joins' components have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
