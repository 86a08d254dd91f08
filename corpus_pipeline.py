"""A corpus pipeline over ``documents``: language, quality, near-duplicates, mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``.  All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptspark.llm import bpe, langid, mixing, near_copies, quality
from conceptspark.runtime import others, stored, table

#: A text whose cosine with every language is below this reads like none of them.  Of 20,000
#: labelled rows with 50 letters or more only single words said over and over score less (5
#: rows); 4,000 characters of random letters, base64 or another script score 0.17 at most.
MIN_LANGUAGE_SCORE = 0.2
#: Texts of fewer letters score lower in their own language: from 10 letters on 0.108 at least.
FULL_LETTERS, MIN_SHORT_SCORE = 50, 0.1
#: Fewer letters than this don't tell a language from noise; such a text stays.
LEAST_LETTERS = 10
MIN_QUALITY = 0.5


def whole(docs: DataFrame) -> DataFrame:
    """(doc, text): all columns as one beside the text, so that none clashes with those of the work."""
    return docs.select(F.struct(*others(docs)).alias("doc"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the rows with a language; drop texts that read like none of them.

    Null and empty texts and texts without letters have no language and go; texts of fewer
    than ``LEAST_LETTERS`` letters stay.  Repeated rows share a fate, an empty table stays
    empty, and columns pass untouched whatever their names.
    """
    found = langid.predict(whole(docs), langid.fit(docs))
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    short = (letters < LEAST_LETTERS) | ((letters < FULL_LETTERS) & (F.col("score") >= MIN_SHORT_SCORE))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & F.when(F.col("score") >= MIN_LANGUAGE_SCORE, True).otherwise(short))
    return kept.select("doc.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels; drop texts that score below ``MIN_QUALITY``.

    Null texts are scored as empty ones.  Without labels of both kinds every score is 0.5, so
    all stay.  Repeated rows share a fate, an empty table stays empty, and columns pass
    untouched whatever their names.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    _, model = quality.learn(docs, labels)
    return quality.score_texts(whole(docs), model).where(F.col("score") >= MIN_QUALITY).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near copies: a Jaccard similarity of
    0.8 or more of the sets of five-word shingles.

    Null and empty texts are one group; a null id comes last.  Rows that repeat id and text are
    one row.  An empty table stays empty, and columns pass untouched whatever their names.
    """
    return near_copies.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the documents as often as the mix does, in whole copies.

    Documents without words stay once.  A null source is a source of its own.  Repeated rows
    are taken one by one, an empty table stays empty, and columns pass untouched.
    """
    return mixing.repeat_documents(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text; its digests stand in its place (those of an empty text for null)."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL can't express the classifiers and the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
