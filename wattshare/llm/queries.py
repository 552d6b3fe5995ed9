"""One registered query for each operator: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshare.llm import sql as oracles
from wattshare.llm.collocations import collocations
from wattshare.llm.common import SPACE_RUN
from wattshare.llm.exact_dedup import exact_duplicates
from wattshare.llm.jaccard_join import near_duplicates
from wattshare.llm.licenses import license_passages
from wattshare.llm.line_dedup import repeated_lines, without_lines
from wattshare.llm.mixing import mixture, with_ranks
from wattshare.llm.packing import packed_pieces
from wattshare.llm.periodic_runs import periodic_runs
from wattshare.llm.personal_data import BASE_KINDS, fit_on, personal_data
from wattshare.llm.secret_scan import secrets
from wattshare.llm.sharding import sharded
from wattshare.llm.toxicity import fit_lexicon, held_out, score_toxicity
from wattshare.llm.vector_dedup import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _span_digest(found: DataFrame, kinds: tuple[str, ...], base: Column) -> DataFrame:
    """Counts by kind and digest of the ``base`` spans alone, beside all spans."""
    counts = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


@query(oracles.EXACT)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"), digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_passages(table(spark, sf_dir, "documents"))
    shown = F.transform("passages", lambda p: F.concat_ws(":", p["licence"], p["dice"], p["start"], p["end"]))
    return found.select(
        "doc_id", F.size("passages").cast("long").alias("n_passages"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["licence"]))), ",").alias("licences"),
        F.array_join(shown, ",").alias("passages"))


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _span_digest(personal_data(docs, fit_on(docs)), BASE_KINDS, F.col("base"))


@query()
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dropped = repeated_lines(docs, copy_share=None)
    counts = dropped.select(
        F.col("_id").alias("doc_id"), F.size("exact").cast("long").alias("n_exact"), F.size("near").cast("long").alias("n_near"))
    counts = counts.withColumnRenamed("doc_id", "_counted")
    cleaned = without_lines(docs.select("doc_id", "text"), dropped)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return cleaned.select("doc_id", lines.alias("n_lines_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).join(
        counts, F.col("doc_id").eqNullSafe(F.col("_counted")), "left").select(
        "doc_id", "n_lines_kept", F.coalesce("n_exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "text_sha256")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit_lexicon(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, lexicon).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No added span is of a base kind.
    kinds = ("assign", "access", "hex")
    base = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return _span_digest(secrets(table(spark, sf_dir, "documents")), kinds, base)


@query(oracles.MIXING)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = with_ranks(mixture(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"),
                        F.array_join("ranks", ",").alias("train_ranks"))


@query()
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


@query(oracles.COLLOCATIONS)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, by the checksum of their id, with a periodic tail.

    With h the CRC-32 of the decimal id and g = floor(h / 10), a document with h % 10 = 0 and n > 0 words repeats the
    p = 1 + floor((n - a) / (3 + g % 8)) words from word a = g % n on to its end.  A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE_RUN, -1), lambda w: w != "")

    def tail(d: Column) -> Column:
        n, g = F.size(d["w"]), F.floor(d["h"] / 10)
        at = F.struct(d["w"].alias("w"), F.pmod(g, n).cast("int").alias("a"), F.pmod(g, F.lit(8)).cast("int").alias("k"))
        bound = F.transform(F.array(at), lambda x: F.struct(
            x["w"].alias("w"), x["a"].alias("a"), (1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + x["k"]))).cast("int").alias("p")))
        return F.get(F.transform(bound, lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(
            i < x["a"], w).otherwise(F.get(x["w"], x["a"] + F.pmod(i - x["a"], x["p"])))), " ")), F.lit(0))

    # Words are bound once per document; named directly inside the inner step they would be split again for each word.
    bound = F.transform(F.array(F.struct(words.alias("w"), h.alias("h"))), lambda d: F.when(
        F.size(d["w"]) > 0, tail(d)).otherwise(""))
    planted = F.get(bound, F.lit(0))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(F.col("text")).alias("text"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.get(F.sort_array(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))), asc=False), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    start, length, period = -longest["start"], longest["length"], -longest["period"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
