"""One query per operator over its whole table, and its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.llm import (
    centroids, chat, decontamination, html, langid, minhash, pii, quality, sentencepieces, sharding, simhash, toxicity, whitening,
)
from addrloom.llm.shared import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_sharding(spark, folder):
    """40 contiguous shards of equal bytes."""
    rows = sharding.shard_rows(table(spark, folder, "documents"), 40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_quality(spark, folder):
    """The ledger of every document, kept if it passes every rule."""
    rows = quality.apply_policy(quality.ledger(table(spark, folder, "documents")), quality.EVERY_RULE)
    base = F.col("failed").bitwiseAND(F.lit(quality.Policy("", quality.BASE).mask)) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "n_lines", "n_alpha_words", "failed", "policy",
    )


@query
def op7_decontamination(spark, folder):
    rows = decontamination.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = decontamination.hit_words(F.col("spans"))
    return rows.select(
        "document.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query
def op8_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op3_pii(spark, folder):
    rows = pii.find(table(spark, folder, "documents"))
    return rows.select(
        "document.doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(*pii.KINDS), 256).alias("base_sha256"), pii.joined(*pii.KINDS, pii.TERM).alias("spans"),
        F.size(pii.TERM).cast("long").alias("n_term"),
    )


@query
def op5_chat(spark, folder):
    return chat.collapse(table(spark, folder, "conversations"))


@query
def op6_langid(spark, folder):
    documents = table(spark, folder, "documents")
    model = langid.fit(documents.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.predict(documents, model)
    return rows.select("document.doc_id", langid.held_out(F.col("document.doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op2_toxicity(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    out = lambda c: langid.held_out(F.col(c), 3, 1)
    rows = toxicity.score(documents, toxicity.fit(documents.where(~out("doc_id")), labels.where(~out("doc_id"))))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.select(
        "document.doc_id", out("document.doc_id").alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "n_toxic", spans.alias("spans"),
    )


@query
def op9_sentencepiece(spark, folder):
    """Ids of every document, and whether they decode to its text again."""
    rows = sentencepieces.encode(table(spark, folder, "documents"), sentencepieces.load(VOCABULARY), check=True)
    return rows.select("document.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("exact").alias("round_trip"), "ids")


@query
def op4_html(spark, folder):
    rows = html.extract(table(spark, folder, "pages"))
    return rows.select("document.page_id", "document.url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op11_minhash(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op12_whitening(spark, folder):
    """A row per vector and component."""
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    each = rows.select("row", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value"))
    return each.select(
        "row.vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "value.whitened", "value.explained", "identity_error",
    )


@query
def op13_centroids(spark, folder):
    rows = centroids.cluster(table(spark, folder, "embeddings"))
    return rows.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
