"""The driver's tables, whole, in the roles of the engine's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.functions import entities as en
from addrloom.models.encoder import CharPairEncoder
from addrloom.plans import vectorize
from addrloom.sources import tables

TEXT_DIM = 256

# label of token number i (from 0) of document d: entry (i + token length + d) mod 13
TOKEN_LABELS = (
    "B-prov", "E-prov", "B-city", "I-city", "E-city", "S-district", "O",
    "I-road", "E-road", "B-poi", "I-poi", "S-houseno", "I-devzone",
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(spark: SparkSession, scan: DataFrame) -> DataFrame:
    """A test table is one file with one row group, which one task would read and
    work on; a small scan is dealt out to all cores.  A large one has its splits
    and is left alone."""
    cores = spark.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= 2 * cores else scan.repartition(cores)


work_folder = tables.work_folder


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("source_id"),
        F.concat(F.lit("E"), "vec_id").alias("enterprise_name"),
        F.concat(F.lit("label "), "label").alias("address"),
        F.col("embedding").alias("vector"),
    )


def reference_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("source_id"),
        F.concat(F.lit("label "), "label").alias("address"),
        F.concat(F.lit("R"), "label").alias("room_no"),
        F.col("embedding").alias("vector"),
    )


def given_centres(references: DataFrame, count: int) -> np.ndarray:
    """The vectors of the smallest ids as centres, so that SQL can use the same."""
    rows = references.orderBy(F.col("source_id").cast("long")).limit(count).select("vector").collect()
    return np.array([r["vector"] for r in rows], dtype=np.float64)


def recall_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as the recalled candidates of their order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("enterprise_id"),
        F.concat(F.lit("order "), "l_orderkey").alias("enterprise_name"),
        F.concat(F.lit("address of "), "l_orderkey").alias("enterprise_address"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("standard_id"),
        F.concat(F.lit("part "), "l_partkey", F.lit(" supplier "), "l_suppkey").alias("standard_address"),
        F.col("l_returnflag").alias("room_no"),
        (F.col("l_quantity") / 50.0).alias("similarity"),
    )


def all_enterprises(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("enterprise_id"),
        F.concat(F.lit("order "), "o_orderkey").alias("enterprise_name"),
        F.concat(F.lit("address of "), "o_orderkey").alias("enterprise_address"),
    )


def event_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Events as corrections of the order numbered like their user; the later
    event counts.  View events leave the id, clicks the address as they are."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("enterprise_id"),
        F.concat(kind, F.lit("-"), "event_id").alias("standard_id"),
        F.when(kind != "view", F.concat(kind, F.lit("-"), "event_id")).alias("address_id"),
        F.when(kind != "click", F.concat(F.lit("value "), F.col("value").cast("decimal(12,2)").cast("string"))).alias("standard_address"),
        F.when(kind != "error", F.get_json_object("props", "$.k")).alias("room_no"),
        "event_id",
    )


def enterprise_texts(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return tables.query_addresses(turns, "id", "role", "text")


def standard_texts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.reference_addresses(spread(spark, table(spark, folder, "documents")), "doc_id", "text", "source")


def _stored(spark: SparkSession, vectors: DataFrame, kind: str) -> DataFrame:
    """Written as a vector table and read back, as between vectorize and recall."""
    path = work_folder(spark, f"{kind}-vectors")
    tables.replace(tables.vector_rows(vectors, kind), path)
    return spark.read.parquet(path)


def encoded_enterprise_texts(spark: SparkSession, folder: str) -> DataFrame:
    return vectorize.encode(enterprise_texts(spark, folder), "enterprise", CharPairEncoder(TEXT_DIM))


def enterprise_text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, encoded_enterprise_texts(spark, folder), "enterprise")


def encoded_standard_texts(spark: SparkSession, folder: str) -> DataFrame:
    return vectorize.encode(standard_texts(spark, folder), "standard", CharPairEncoder(TEXT_DIM))


def standard_text_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, encoded_standard_texts(spark, folder), "standard")


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn and the turn after it; the last of a conversation has none."""
    turns = spread(spark, table(spark, folder, "conversations")).alias("a")
    following = table(spark, folder, "conversations").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text")
    )
    return turns.join(following, ["conv_id", "turn"], "left").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), "role", "text", "next_text"
    )


def labelled_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All words of every document, each with a label."""
    documents = spread(spark, table(spark, folder, "documents").select("doc_id", "text"))
    words = documents.withColumn("tokens", F.split("text", " "))
    labels = F.array(*[F.lit(x) for x in TOKEN_LABELS])
    return words.withColumn(
        "labels",
        F.transform(
            "tokens",
            lambda t, i: F.element_at(
                labels, (F.pmod(i + F.char_length(t) + F.col("doc_id"), F.lit(len(TOKEN_LABELS))) + 1).cast("int")
            ),
        ),
    )


def document_entities(spark: SparkSession, folder: str) -> DataFrame:
    return en.spans_to_entities(en.clean_tokens(labelled_tokens(spark, folder)))


def tagged_documents(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    df = document_entities(spark, folder)
    fields = en.FIELDS[mode](F.col("entities"))
    base = [F.col("doc_id").cast("string").alias("_id_field"), F.col("text").alias("original_address")]
    if mode != "12":
        base.append(en.dom_json(F.col("entities")).alias("dom_json"))
    return df.select(*base, *[c.alias(n) for n, c in fields.items()])


def customer_places(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer as a house: nation = district, market segment = road."""
    name = F.col("n_name")
    several = lambda word: F.array(*[F.concat(name, F.lit(d + word)) for d in ("东", "西", "南")])
    customers, nations = spread(spark, table(spark, folder, "customer")), table(spark, folder, "nation")
    return customers.join(nations, customers["c_nationkey"] == nations["n_nationkey"]).select(
        "c_custkey",
        name.alias("district"),
        F.concat("c_mktsegment", F.lit("路")).alias("road"),
        F.col("c_custkey").alias("number"),
        several("街道").alias("streets"), several("社区").alias("communities"), several("商务大厦").alias("buildings"),
    )


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    """Every nation as a district of three roads, streets, communities and buildings."""
    name = F.col("n_name")
    several = lambda words: F.array(*[F.concat(name, F.lit(w)) for w in words])
    places = lambda word: several([d + word for d in ("东", "西", "南")])
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("int").alias("district_no"), name.alias("district"), several(("一路", "二路", "三路")).alias("roads"),
        places("街道").alias("streets"), places("社区").alias("communities"), places("商务大厦").alias("buildings"),
    )


def place_names(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """One-column address table of customers or suppliers."""
    prefix = {"customer": "c", "supplier": "s"}[source]
    key = {"customer": "c_custkey", "supplier": "s_suppkey"}[source]
    rows, nations = table(spark, folder, source), table(spark, folder, "nation")
    return rows.join(nations, rows[f"{prefix}_nationkey"] == nations["n_nationkey"]).select(
        F.concat("n_name", F.lit(" No."), key).alias("address")
    )
