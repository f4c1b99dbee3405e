"""Registered queries of the llm operators: thin digests of what the operators return over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, flac, html, langid, licences, merkle, minhash, neighbours, packing, quality, runs, secrets, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _byte_bpe(), capacity=1024, end_id=2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality.score_quality(_table(spark, sf_dir, "documents"), trusted)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)
    digest = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id")))
    found = langid.identify(docs, langid.train(docs.where("not held_out")))
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2).drop("mark")


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    return flac.media_features(flac.store_media(rows))


def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"), _byte_bpe())
    return found.select("doc_id", *[f"secrets.{c}" for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.planted(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.periodic_runs(docs, least=24, times=3, keep=["doc_id"]).withColumn("b", runs.best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = ["b.start", "b.length", "b.period", F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli")]
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0, top=20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = _table(spark, sf_dir, "documents"), F.col("text")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate(text, upper, lower)).otherwise(text)
    return merkle.manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": tampered})


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_decontamination": op3_decontamination,
    "op4_language_id": op4_language_id,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_flac_media": op6_flac_media,
    "op7_warc_zip": op7_warc_zip,
    "op8_secret_scan": op8_secret_scan,
    "op9_licence_scan": op9_licence_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_nearest_neighbours": op12_nearest_neighbours,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": pipeline,
}
