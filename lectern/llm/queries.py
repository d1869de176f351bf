"""One query per operator, over the whole of its tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    bpe,
    collocations,
    decontaminate,
    fingerprint,
    language,
    licenses,
    pii,
    quality,
    quotes,
    secrets,
    simhash,
    warc,
    whitening,
)
from lectern.plans.sizing import staging_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.learn(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{staging_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages without quotes, with what they reply to and their thread."""
    return quotes.formatted(table(spark, sf_dir, "conversations"))


def op4_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the heuristic labellers' votes on all of them."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs))


def op5_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets of every document, through a ledger that begins empty."""
    found = secrets.scan(table(spark, sf_dir, "documents"), fresh_folder(spark, "ledger"))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(s):
        return F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["until"].cast("string"))

    spans = F.array_join(F.transform("spans", listed), ",")
    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op8_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the bundles it was written to."""
    folder = fresh_folder(spark, "warc")
    index = warc.write_bundles(table(spark, sf_dir, "pages"), folder)
    found = warc.read_bundles(index, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses and license notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them, as digests."""
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, decode=True)
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_digest(found: DataFrame, path: str) -> DataFrame:
    """Numbers of strict spans by kind, their digest, and all spans as text."""

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    def listed(s):
        return F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["until"].cast("string"))

    base = F.array_join(F.transform(F.filter("spans", lambda s: s["base"]), listed), ",")
    return found.select(
        path, *[number(k) for k in pii.KINDS], F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", listed), ",").alias("spans"))


def op11_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: strict matches, and loose ones that the trained classifier takes."""
    return op11_digest(pii.scan(table(spark, sf_dir, "documents")), "doc_id")


def op12_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the eight leading components of all of them."""
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit(vectors))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_svm": op1_language_svm,
    "op2_simhash_pigeonring": op2_simhash_pigeonring,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_weak_labels": op4_weak_labels,
    "op5_weighted_sampling": op5_weighted_sampling,
    "op6_secret_ledger": op6_secret_ledger,
    "op7_decontamination": op7_decontamination,
    "op8_warc_seekable": op8_warc_seekable,
    "op9_license_patience": op9_license_patience,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_weak_pii": op11_weak_pii,
    "op12_feast_whitening": op12_feast_whitening,
    "op13_phrase_collocations": op13_phrase_collocations,
}
