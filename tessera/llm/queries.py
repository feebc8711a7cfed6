"""Registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chunk_dedup, decontaminate, embedding_dedup, html_main, merkle_manifest, ngram_join, oracles, periodic_runs, quality_rules, source_mix, toxicity_knn, url_reputation, warc_fixity

#: The vocabulary file is a parameter; this is the one the queries use.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Whether a row's labels are kept from learning; false for a null doc_id, whose labels teach nothing anyway."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixity drill over all pages, by the first two digits of the md5 of their ids: the second replica lost the
    records of 00 before it was written, so that later ones moved up, and those of 03 after; 01 was altered at equal
    length and 02 grew by one letter. The audit has to find exactly these."""
    pages = table(spark, sf_dir, "pages")
    mark = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    html = F.when(mark == "01", F.translate("html", "<", "{")).when(mark == "02", F.concat(F.col("html"), F.lit("x"))).otherwise(F.col("html"))
    replica = warc_fixity.manifest(warc_fixity.warc_records(pages.where(mark.isNull() | (mark != "00")).withColumn("html", html)))
    replica = replica.where(mark.isNull() | (mark != "03"))
    return warc_fixity.audit(warc_fixity.manifest(warc_fixity.warc_records(pages)), replica)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), VOCABULARY, digest_only=True)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_reputation.url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("bad_share", 6).alias("bad_share"), F.round("bad_low", 6).alias("bad_low"), "n_labelled")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_rules.train(docs, labels.where(~held_out()))
    return quality_rules.quality_scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_knn.toxicity(docs, labels.where(~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("neighbours").alias("evidence"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken(source_mix.mix(table(spark, sf_dir, "documents")))


def repeating(docs: DataFrame) -> DataFrame:
    """The drill of op12: where crc32(doc_id) % 10 is 0, the words from some word on repeat the first few of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit(source_mix.WORD), F.lit(0)))
    g, n = F.floor(h / 10).cast("long"), F.size("words").cast("long")
    docs = docs.select("doc_id", "text", words.alias("words"), g.alias("g"))
    docs = docs.withColumn("a", F.when(F.size("words") > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform("words", lambda w, i: F.get("words", place(i).cast("int"))), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, a tenth of which repeat a part of themselves; the longest one, and digests of all."""
    found = periodic_runs.periodic_runs(repeating(table(spark, sf_dir, "documents")))
    first = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int"))[0]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", F.when(F.size("runs") > 0, first)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, roots and proof; of every second one, by crc32(doc_id), the text lost its line feeds meanwhile."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    now = merkle_manifest.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace("text", F.lit("\n"), F.lit("")))
    made = merkle_manifest.manifest(table(spark, sf_dir, "documents"), lambda: F.when(even, now))
    folded = merkle_manifest.folded(F.coalesce("carried", "leaf"), F.col("proof"))
    out = made.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_warc_fixity, op2_embedding_dedup, op3_ngram_join, op4_bpe, op5_url_filter, op6_quality, op7_chunk_dedup, op8_main_text, op9_decontaminate, op10_toxicity, op11_source_mix, op12_periodic_runs, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
