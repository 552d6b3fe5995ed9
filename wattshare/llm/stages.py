"""Stages of the corpus pipeline: each applies one operator's decisions to whole documents.

Every stage takes (spark, docs, sf_dir).  Rows are told apart by id and text, so rows that repeat an id with another text
are decided on their own; rows that repeat both are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshare.llm.common import if_small
from wattshare.llm.jaccard_join import near_duplicates
from wattshare.llm.line_dedup import repeated_lines, without_lines
from wattshare.llm.mixing import mixture
from wattshare.llm.packing import packed_pieces
from wattshare.llm.queries import table, tokenizer_path
from wattshare.llm.toxicity import fit_lexicon, score_column
from wattshare.session import staged, staged_alone, staged_tables

#: Score from which a document is rejected.
REJECTED = 0.5


def row_key() -> Column:
    """Sorts like the id, null last; distinguishes rows that share an id by their text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))


def _boxed(docs: DataFrame) -> DataFrame:
    """``doc`` (all columns of the row, whatever their names) beside ``key``."""
    return docs.select(F.struct("*").alias("doc"), row_key().alias("key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches ``REJECTED`` go; the lexicon is learned from labelled documents of the input.

    Null and empty texts score as texts without any listed word and stay; repeated rows get the same score; very long texts
    are scored whole; an empty table gives an empty table.
    """
    lexicon = fit_lexicon(docs, table(spark, sf_dir, "labels"))
    return docs.filter(score_column(lexicon, F.col("text")) < REJECTED)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go from the texts, repeats within one document too.

    Documents with equal texts count as their first: all of them lose what it loses, so whole copies stay copies and are
    left to the next stage.  Every other document loses its repeated lines, however many they are.  Null and empty
    texts stay as they are; a null id counts as the last; an empty table gives an empty table.
    """
    keyed = docs.select(
        F.struct("*").alias("doc"), F.col("text").alias("text"), row_key().alias("own"), F.xxhash64("text").alias("t"),
        F.hash("text").alias("u"), F.length("text").alias("n"))
    copies = staged(keyed.filter("n > 0").groupBy("t", "u", "n").agg(
        F.min("own").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "stage-copies")
    keyed = keyed.join(if_small(copies), ["t", "u", "n"], "left").withColumn("whole", F.coalesce("first", "own"))
    dropped = repeated_lines(keyed.filter("own = whole").select("whole", "text"), id_col="whole", copy_share=None)
    cut = without_lines(keyed.select("doc", "whole", "text"), dropped, id_col="whole")
    return cut.select(F.col("doc").withField("text", F.col("text")).alias("doc")).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar shingles the document with the smallest id stays, and all without shingles.

    Null and empty texts have no shingles and stay, each row of them; of rows equal in id and text one stays; a null id counts
    as the last; an empty table gives an empty table.
    """
    texts = docs.select(row_key().alias("key"), "text")
    since = staged_tables(spark)
    found = staged_alone(near_duplicates(texts, id_col="key"), "stage-near", since)
    extra = staged(found.filter((F.col("n_shingles") > 0) & (F.col("key") != F.col("component_id"))).select(
        F.col("key").alias("gone")).distinct(), "stage-gone")
    kept = _boxed(docs).join(if_small(extra), F.col("key") == F.col("gone"), "left_anti")
    repeats = staged(found.filter("n_shingles > 0 AND key = component_id").groupBy("key").count().filter(
        "count > 1").select(F.col("key").alias("again")), "stage-repeats")
    if not repeats.isEmpty():
        again = F.col("key") == F.col("again")
        kept = kept.join(repeats, again, "left_anti").unionByName(
            kept.join(repeats, again, "left_semi").dropDuplicates(["key"]))
    return kept.select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix begins it, in training order; those it never begins go.

    Null texts and texts without words are never begun; rows equal in id and text are one document; a null source is a source
    of its own; an empty table gives an empty table.
    """
    since = staged_tables(spark)
    mixed = staged_alone(
        mixture(docs.select(row_key().alias("key"), "text", "source"), id_col="key").select("key", "positions"), "stage-mix", since)
    begun = staged(mixed.select(
        F.col("key").alias("begun"), F.posexplode("positions").alias("reading", "position")), "stage-begun")
    keyed = _boxed(docs)
    if not mixed.groupBy("key").count().filter("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["key"])
    met = keyed.join(begun, F.col("key") == F.col("begun"))
    return met.orderBy("position", "key", "reading").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths; null and empty texts give their end token, repeated rows are packed each."""
    return packed_pieces(docs, tokenizer_path())
