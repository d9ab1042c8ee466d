"""From raw documents to token ids, a stage at a time.

Each stage takes the documents its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.llm import decontamination, langid, nearcopies, pii, sentencepieces
from addrloom.llm.shared import stored, table

# a text whose letters name no language with this mean probability is rejected
MIN_LANGUAGE_SCORE = 0.3
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# bytes of the batches that an executor and its Python workers each hold a few of; a longer text is a batch of its own
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH_BYTES``, not Spark's 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; texts without a letter, and
    texts in none of them, go."""
    small_batches(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, tuple(c for c in docs.columns if c != "text"), with_text=True, reject=True)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col("text" if c == "text" else f"document.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group that links of a five-word Jaccard similarity of 0.8 or more join, found by
    fingerprints.  Null and empty texts are copies of one another; rows of one id and text are one; rows without an id stay;
    an empty table gives no rows."""
    small_batches(spark)
    return nearcopies.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.  Null and empty texts have none and stay, as do all rows of an id that repeats;
    an empty table gives no rows."""
    small_batches(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and the terms that disclose it replaced; ``n_chars`` follows the text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text.  A null or empty text has no ids; every row of an id that
    repeats has its own; an empty table gives no rows."""
    small_batches(spark)
    rows = sentencepieces.encode(docs, sentencepieces.load(VOCABULARY), ("doc_id", "lang", "source"), check=True)
    return rows.select(
        "document.doc_id", "document.lang", "document.source", F.size("ids").cast("long").alias("n_tokens"),
        F.col("exact").alias("round_trip"), "ids",
    )


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("sanitised", sanitised),
    ("tokens", tokens),
]

# recurrent networks, components and segmentations are no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
