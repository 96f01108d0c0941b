"""The corpus pipeline: language ID, near-duplicate removal, removal of repeated
passages, mixing to target weights, and tokens.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all rows that its
predecessor kept. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotaflow.llm.chosen_path import similar_documents
from quotaflow.llm.common import table, written
from quotaflow.llm.langid import UNDETERMINED, fit_languages, identify_languages
from quotaflow.llm.mixing import mixed_rows
from quotaflow.llm.pieces import encode_pieces
from quotaflow.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this share of the best language's score the language is rejected as unclear.
CLEAR = 0.3
#: Near duplicates: words of a shingle and similarity in percent.
SHINGLE, SIMILAR = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows that are not held out; rejects texts without
    a letter and texts whose language is unclear."""
    found = identify_languages(docs.select(*COLUMNS), fit_languages(docs))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= CLEAR)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of every near-duplicate group,
    and rows without a doc_id; repeated rows of a doc_id stay together."""
    kept = similar_documents(docs, size=SHINGLE, percent=SIMILAR).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    return named.union(docs.where("doc_id IS NULL")).select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; a null text stays null."""
    done = remove_repeats(docs.withColumn("was_null", F.col("text").isNull()), keep=("lang", "source", "was_null"), characters=True)
    text = F.when(~F.col("was_null"), F.decode("kept", "UTF-8"))
    return done.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in output order."""
    return mixed_rows(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_pieces(docs, keep=COLUMNS)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", passage_dedup),
          ("mixing to target weights", mix), ("SentencePiece encoding", tokens)]

#: Language ID, minwise sketches and suffix arrays have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
