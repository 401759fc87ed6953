"""The registered queries of the training-data operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, html_extraction, lexical_search, license_scan, mixing, oracles, packing, quality_classifier, quality_rules, secrets, sharding, simhash, url_filter
from .common import table

#: The fixed rules of the URL query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model, keep=["doc_id"]).select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.verdicts(found).drop("near_items")


def op4_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 with the proximity matches: near_items, the ids of items whose rarest terms stand close together."""
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=decontamination.SPAN)
    return decontamination.verdicts(found)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    judged = quality_rules.apply_policy(rows, quality_rules.POLICIES[quality_rules.CURRENT])
    base = quality_rules.failed("few_words", "repeated_windows")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def op5_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and what would be kept without it, from the ledger of all documents."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]), quality_rules.POLICIES[quality_rules.CURRENT])


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.template_table(spark), keep=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _joined(spans):
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    rank = lambda s: F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).otherwise(2)
    keyed = F.array_sort(F.transform(F.concat("spans", "added"), lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_joined("spans"), 256).alias("base_sha256"), _joined(keyed).alias("spans"), "n_truncated")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


def op11_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mixing.mixture(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixing.taken(documents, pieces).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "first_slot")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.label(conversations.damage(table(spark, sf_dir, "conversations"))))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_best_fit_packing, op3_sampled_splitters, op4_decontamination, op4_proximity, op5_quality_rules, op5_ablation, op6_url_filter, op7_license_scan, op8_simhash, op9_secret_scan, op10_html_extraction, op11_source_mixture, op12_lexical_search, op13_conversation_repair)}

#: The others' hashes, fits and decodings have no SQL form; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": oracles.decontamination(decontamination.WIDTH),
    "op5_quality_rules": oracles.quality_rules(),
    "op5_ablation": oracles.ablation(),
    "op6_url_filter": oracles.url_filter(URL_RULES),
    "op12_lexical_search": oracles.lexical_search(lexical_search.K),
    "op13_conversation_repair": oracles.conversation_repair(),
}
