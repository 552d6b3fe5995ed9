"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattshare.llm.common import BROADCAST_ROWS, if_small, one_spaced, text_or_empty
from wattshare.session import staged

LEVELS = ("length", "prefix", "whole")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64,
    broadcast_rows: int = BROADCAST_ROWS, digests: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, decided_by``, with ``digests`` also ``text_sha256``.

    Texts are equal when identical after every run of white space became one blank; of equal texts the row with the
    smallest id stays.  Rows pass through three sieves, and each sees only what the one before could not tell apart:

    * ``length``: the only text of its length,
    * ``prefix``: the only one of its length with that hash of the first ``prefix_chars`` characters,
    * ``whole``: compared by SHA-256 of the whole text.

    Texts never enter a shuffle.  Lengths are counted first; prefixes are hashed and counted for lengths that repeat
    alone; while the keys that survive are few (counted), they are broadcast and the whole text is hashed for surviving
    rows alone; beyond ``broadcast_rows`` each text is hashed as it is scanned and the hashes meet the keys in a
    shuffle.  Groups are counted by combinable aggregates and joined back on the hash, which Spark splits where one
    is hot.  ``digests`` hashes every text in that same scan, for whoever wants the lower-case hex of each.

    Nulls count as empty text; empty texts equal each other.  Ids may be null (a group with other ids keeps the
    smallest of those) or repeat: of rows that tie on id and text exactly one is ``kept``.  Very long texts are
    read whole; an empty table gives an empty table.
    """
    text = one_spaced(text_or_empty(F.col(text_col)))
    scan = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).withColumn("_len", F.length("_t"))
    lengths = staged(scan.groupBy("_len").agg(F.count(F.lit(1)).alias("_n_len")).filter("_n_len > 1"), "exact-lengths")
    # Never more rows than the longest text has characters.
    repeated = if_small(lengths, broadcast_rows)
    prefixed = scan.withColumn("_pre", F.xxhash64(F.substring("_t", 1, prefix_chars)))
    seen = prefixed.join(repeated.select("_len"), "_len", "left_semi").groupBy("_len", "_pre").agg(F.count(F.lit(1)).alias("_n"))
    keys = staged(seen.filter("_n > 1").select("_len", "_pre", F.lit(True).alias("_open")), "exact-open")
    digest = F.unhex(F.sha2("_t", 256))
    kept = ["_id", "_len", *([digest.alias("_digest")] if digests else [])]
    if keys.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows = prefixed.join(F.broadcast(keys), ["_len", "_pre"], "left").select(
            *kept, F.when(F.col("_open"), digest).alias("_whole"))
    else:
        every = prefixed.select(*kept, "_pre", digest.alias("_hash"))
        rows = every.join(keys, ["_len", "_pre"], "left").select(
            *[c if isinstance(c, str) else "_digest" for c in kept], F.when(F.col("_open"), F.col("_hash")).alias("_whole"))
    # Rows get a number once they are stored: ties on the id are broken by it.
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "exact-rows")
    groups = rows.filter(F.col("_whole").isNotNull()).groupBy("_whole").agg(
        F.count(F.lit(1)).alias("_size"), F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first"))
    # Most hashes occur once: only groups of several take part in the join.
    several = groups.filter("_size > 1")
    # Rows that an earlier sieve decided have no hash and skip the join: their nulls would meet in one task.
    alone = rows.filter(F.col("_whole").isNull()).withColumns({
        "_size": F.lit(None).cast("long"), "_first": F.lit(None).cast(several.schema["_first"].dataType)})
    hashed = rows.filter(F.col("_whole").isNotNull()).join(several, "_whole", "left")
    out = hashed.unionByName(alone).join(repeated, "_len", "left")
    grouped = F.col("_size").isNotNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(grouped, F.col("_first._id")).otherwise(F.col("_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(grouped, F.col("_first._row") == F.col("_row")).otherwise(True).alias("kept"),
        F.when(F.col("_whole").isNotNull(), LEVELS[2]).when(F.col("_n_len").isNotNull(), LEVELS[1])
        .otherwise(LEVELS[0]).alias("decided_by"), *([F.lower(F.hex("_digest")).alias("text_sha256")] if digests else []))


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, text_sha256``: lower-case hex SHA-256 of every text after white space became single blanks."""
    return docs.select(id_col, F.sha2(one_spaced(text_or_empty(F.col(text_col))), 256).alias("text_sha256"))
