"""One runnable query per operator, over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom import schemas, vocab
from addrloom.functions import entities as en
from addrloom.functions import prefixes, scores, vectors
from addrloom.functions import text as tx
from addrloom.models.encoder import CharPairEncoder
from addrloom.models.pair_scorer import LogitPairScorer, SimilarityScorer
from addrloom.models.plugged import PluggedEncoder, PluggedPairScorer
from addrloom.models.tagger import LevelWordTagger
from addrloom.operators import centre_tree, checks, copies, corrections, filters, knn, page_store, pages, pending, rank, recall, stats
from addrloom.plans import corrections as stored_corrections
from addrloom.plans import evaluation, match, pairs, tagging, vectorize
from addrloom.sources import csv, logs, snapshots, tables, tags
from addrloom.streaming import incremental
from registry import views as v

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _r6(*names: str) -> dict[str, Column]:
    return {n: F.round(n, 6) for n in names}


# -- nearest neighbours -------------------------------------------------------------

@query
def knn_topn(spark, folder):
    found = knn.knn_join(v.query_vectors(spark, folder), v.reference_vectors(spark, folder), 5)
    return found.withColumns(_r6("similarity"))


@query
def knn_threshold(spark, folder):
    found = knn.knn_join(v.query_vectors(spark, folder), v.reference_vectors(spark, folder), 5, 0.3)
    return found.withColumns(_r6("similarity"))


@query
def knn_cells(spark, folder):
    """The same join cut into many small cells and chunks."""
    found = knn.knn_join(
        v.query_vectors(spark, folder), v.reference_vectors(spark, folder), 5, 0.3, cell_rows=128, chunk_rows=256
    )
    return found.withColumns(_r6("similarity"))


@query
def knn_axes(spark, folder):
    """The same join with a first look along twelve axes."""
    found = knn.knn_join(
        v.query_vectors(spark, folder), v.reference_vectors(spark, folder), 5, cell_rows=512, axes=12
    )
    return found.withColumns(_r6("similarity"))


@query
def knn_single(spark, folder):
    first = v.query_vectors(spark, folder).orderBy(F.col("source_id").cast("long")).select("vector").first()
    return knn.search(v.reference_vectors(spark, folder), first["vector"], 10).withColumns(_r6("similarity"))


@query
def knn_ivf(spark, folder):
    references = v.reference_vectors(spark, folder)
    centres = v.given_centres(references, 16)
    found = knn.ivf_join(v.query_vectors(spark, folder), knn.with_list_id(references, centres), centres, 5)
    return found.withColumns(_r6("similarity"))


@query
def knn_ivf_all_lists(spark, folder):
    """Searching every list finds the exact result."""
    references = v.reference_vectors(spark, folder)
    centres = knn.fit_centres(references, lists=16)
    found = knn.ivf_join(
        v.query_vectors(spark, folder), knn.with_list_id(references, centres), centres, 5, probes=16
    )
    return found.withColumns(_r6("similarity"))


@query
def knn_ivf_recall(spark, folder):
    truth = knn_topn(spark, folder)
    return knn.recall_share(knn_ivf(spark, folder), truth).withColumns(_r6("recall"))


@query
def knn_ivf_tree(spark, folder):
    """Lists below a tree of centres: 64 under the nearest of 8."""
    references = v.reference_vectors(spark, folder)
    given = v.given_centres(references, 72)
    tree = centre_tree.given_tree(given[:8], given[8:])
    found = knn.ivf_join(v.query_vectors(spark, folder), knn.with_list_id(references, tree), tree, 5, probes=3)
    return found.withColumns(_r6("similarity"))


@query
def knn_ivf_tree_all_lists(spark, folder):
    """A fitted tree: searching every list finds the exact result."""
    references = v.reference_vectors(spark, folder)
    tree = centre_tree.fit_tree(references, lists=200, branching=16)
    found = knn.ivf_join(
        v.query_vectors(spark, folder), knn.with_list_id(references, tree), tree, 5, probes=len(tree)
    )
    return found.withColumns(_r6("similarity"))


# -- recall rows ----------------------------------------------------------------------

@query
def recall_regroup(spark, folder):
    nested = recall.regroup(v.recall_rows(spark, folder))
    return nested.select(
        *recall.ENTERPRISE,
        F.size("candidates").cast("long").alias("candidate_count"),
        F.array_join(F.transform("candidates", lambda c: F.concat_ws(
            "|", c["source_id"], c["address"], c["room_no"], F.round(c["similarity"] * 50).cast("int")
        )), ",").alias("candidates"),
    )


@query
def recall_regroup_top(spark, folder):
    """The three best candidates of every order, nested."""
    nested = recall.regroup(v.recall_rows(spark, folder), 3)
    ids = F.array_join(F.transform("candidates", lambda c: c["source_id"]), ",").alias("candidates")
    return nested.select(*recall.ENTERPRISE, F.size("candidates").cast("long").alias("candidate_count"), ids)


@query
def recall_flatten(spark, folder):
    return recall.flatten(recall.regroup(v.recall_rows(spark, folder)))


@query
def recall_summary(spark, folder):
    return recall.summary(v.recall_rows(spark, folder))


# a backslash takes the next character as it is: here a plain p
RECALL_FILTERS = {"keyword": r"\part 1_ ", "min_similarity": 0.2, "max_similarity": 0.9}


@query
def recall_filter(spark, folder):
    return v.recall_rows(spark, folder).where(filters.recall_filter(RECALL_FILTERS))


@query
def recall_filter_count(spark, folder):
    return pages.page_info(v.recall_rows(spark, folder).where(filters.recall_filter(RECALL_FILTERS)), 3, 20)


@query
def recall_page(spark, folder):
    return pages.recall_page(v.recall_rows(spark, folder), {"min_similarity": 0.5}, 3, 20)


@query
def recall_by_ids(spark, folder):
    wanted = v.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("enterprise_id"))
    return filters.by_ids(v.recall_rows(spark, folder), wanted)


@query
def recall_sink_rows(spark, folder):
    """Stored layout: NULL rooms as '', id columns as text."""
    rows = v.recall_rows(spark, folder).withColumn("room_no", F.nullif("room_no", F.lit("N")))
    return tables.recall_rows(rows).drop("created_at")


# -- ranking ----------------------------------------------------------------------------

def _rounded(matches: DataFrame) -> DataFrame:
    return matches.withColumns(_r6("exact_match", "partial_match", "not_match"))


def _matches(spark, folder, policy="rounded", threshold=0.0, everyone=False) -> DataFrame:
    queries = v.all_enterprises(spark, folder) if everyone else None
    return match.rank_recall(v.recall_rows(spark, folder), SimilarityScorer(), policy, threshold, queries)


@query
def rank_rounded(spark, folder):
    return _rounded(_matches(spark, folder))


@query
def rank_raw(spark, folder):
    return _rounded(_matches(spark, folder, "raw"))


@query
def rank_threshold(spark, folder):
    """Threshold left to its default."""
    return _rounded(_matches(spark, folder, threshold=None))


@query
def rank_keep_unmatched(spark, folder):
    return _rounded(_matches(spark, folder, threshold=0.5, everyone=True))


@query
def candidate_threshold(spark, folder):
    return v.recall_rows(spark, folder).where(rank.passes(0.8))


@query
def status_argmax(spark, folder):
    lines = v.table(spark, folder, "lineitem")
    status = scores.match_status(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 500)
    return lines.groupBy(status.alias("match_status"), "l_discount", "l_tax").agg(F.count("*").alias("n"))


@query
def round_half_even(spark, folder):
    lines = v.table(spark, folder, "lineitem")
    return lines.groupBy(scores.round2(F.col("l_quantity") / 8).alias("rounded")).agg(F.count("*").alias("n"))


@query
def class_names(spark, folder):
    index = (F.col("event_id") % 4).cast("int")
    return v.table(spark, folder, "events").groupBy(scores.class_name(index).alias("class_name")).agg(F.count("*").alias("n"))


# -- match rows ---------------------------------------------------------------------------

def _corrected(spark, folder) -> DataFrame:
    base = _matches(spark, folder, threshold=0.5, everyone=True)
    picks = v.event_corrections(spark, folder).drop("address_id")
    return corrections.apply_picks(base, picks, "event_id")


@query
def correct_pick(spark, folder):
    return _rounded(_corrected(spark, folder))


@query
def correct_edit(spark, folder):
    base = _matches(spark, folder, threshold=0.5, everyone=True)
    edits = v.event_corrections(spark, folder).drop("standard_id")
    return _rounded(corrections.apply_edits(base, edits, "event_id"))


@query
def merge_corrections(spark, folder):
    """Matches stored in cells of their ids, picked corrections merged into the cells they fall in."""
    target = v.work_folder(spark, "matches")
    stored_corrections.store_matches(_matches(spark, folder, threshold=0.5, everyone=True), target)
    stored_corrections.merge_picks(spark, target, v.event_corrections(spark, folder).drop("address_id"), "event_id")
    return _rounded(tables.read(spark, target).drop("created_at"))


@query
def merge_edits(spark, folder):
    """The same with direct edits, the merge repeated as after a failure."""
    target = v.work_folder(spark, "matches")
    stored_corrections.store_matches(_matches(spark, folder, threshold=0.5, everyone=True), target)
    for _ in range(2):
        stored_corrections.merge_edits(spark, target, v.event_corrections(spark, folder).drop("standard_id"), "event_id", "edits")
    return _rounded(tables.read(spark, target).drop("created_at"))


@query
def replace_versions(spark, folder):
    """Recall rows replaced by a selection of themselves, then extended; the old versions removed."""
    target = v.work_folder(spark, "recall")
    rows = v.recall_rows(spark, folder)
    snapshots.publish(rows, target, "enterprise_id")
    snapshots.publish(tables.read(spark, target).where("room_no <> 'R'"), target, "enterprise_id")
    snapshots.append(rows.where("room_no = 'R' and similarity >= 0.5").withColumn("similarity", F.lit(1.0)), target)
    snapshots.vacuum(spark, target)
    return tables.read(spark, target).withColumn("versions", F.lit(snapshots.versions(spark, target).count()))


@query
def correction_report(spark, folder):
    return corrections.correction_report(v.all_enterprises(spark, folder), v.event_corrections(spark, folder))


MATCH_FILTERS = {
    "match_status": vocab.EXACT, "min_exact_match": 0.5, "max_partial_match": 0.4, "keyword": "supplier 1",
    "correction_source": vocab.SOURCE_AUTO, "min_not_match": 0, "max_exact_match": 1.0,
}


@query
def match_filter(spark, folder):
    return _rounded(_corrected(spark, folder).where(filters.match_filter(MATCH_FILTERS)))


@query
def match_source_filter(spark, folder):
    """The word shown to people stands for the stored one."""
    return _rounded(_corrected(spark, folder).where(filters.match_filter({"correction_source": "人工选择"})))


@query
def match_page(spark, folder):
    return _rounded(pages.match_page(_corrected(spark, folder), {"min_exact_match": 0.2}, 4, 25))


@query
def match_page_deep(spark, folder):
    """A page far down a stored result."""
    path = v.work_folder(spark, "match-pages")
    page_store.store(_corrected(spark, folder), pages.match_order(), path, 2_000)
    return _rounded(page_store.page(spark, path, 200, 25))


@query
def match_stats(spark, folder):
    rows = stats.match_stats(_corrected(spark, folder))
    return rows.withColumns(_r6(*[c for c in rows.columns if c.startswith("avg_") or c.endswith("_rate")]))


@query
def match_sink_rows(spark, folder):
    aligned = tables.match_rows(_matches(spark, folder).drop("correction_source"))
    return _rounded(aligned.drop("created_at"))


# -- pairs ----------------------------------------------------------------------------------

def _pairs(spark, folder) -> DataFrame:
    return pairs.match_pairs(v.turn_pairs(spark, folder), "text", "next_text", "id")


@query
def pair_scores(spark, folder):
    return _rounded(_pairs(spark, folder))


@query
def pair_sink_rows(spark, folder):
    return _rounded(tables.pair_rows(_pairs(spark, folder)).drop("created_at"))


@query
def pair_blank_rows(spark, folder):
    turns = v.turn_pairs(spark, folder)
    blank = tx.is_blank(F.col("text")) | tx.is_blank(F.col("next_text"))
    return turns.where(blank).select("id", "text")


@query
def pair_stats(spark, folder):
    rows = stats.pair_stats(_pairs(spark, folder))
    return rows.withColumns(_r6(*[c for c in rows.columns if c.startswith("avg_") or c.endswith("_rate")]))


PAIR_FILTERS = {"max_not_match": 0.9, "keyword": "an"}


@query
def pair_page(spark, folder):
    return _rounded(pages.pair_page(_pairs(spark, folder), PAIR_FILTERS, 2, 20))


@query
def pair_copy(spark, folder):
    turns = v.turn_pairs(spark, folder)
    return _rounded(copies.with_pair_scores(turns, "text", "next_text", _pairs(spark, folder)))


# -- tagging ----------------------------------------------------------------------------------

@query
def bio_spans(spark, folder):
    spans = v.document_entities(spark, folder).select("doc_id", F.posexplode("entities").alias("entity_no", "e"))
    return spans.select("doc_id", F.col("entity_no").cast("long").alias("entity_no"), "e.tag", "e.text")


@query
def dom_json(spark, folder):
    return v.document_entities(spark, folder).select("doc_id", en.dom_json(F.col("entities")).alias("dom_json"))


@query
def tag12_fields(spark, folder):
    return v.tagged_documents(spark, folder, "12")


@query
def tag17_fields(spark, folder):
    return v.tagged_documents(spark, folder, "17").drop("dom_json")


@query
def tag17_2_fields(spark, folder):
    return v.tagged_documents(spark, folder, "17_2").drop("dom_json")


@query
def tag12_rules(spark, folder):
    """All rule passes over the entities of whole documents."""
    df = en.apply_rules(v.document_entities(spark, folder), "text")
    return df.select("doc_id", *[c.alias(n) for n, c in en.fields_12(F.col("entities")).items()])


@query
def suffix_tests(spark, folder):
    """Building, room and area words at the end of generated addresses."""
    made = _variants(spark, folder)
    a = F.col("standard_address")
    return made.select(
        "c_custkey", tx.is_building(a).alias("building"), tx.is_room(a).alias("room"), tx.is_area(a).alias("area")
    )


@query
def retag_by_suffix(spark, folder):
    """Suffix rules over one building entity and one room entity per address."""
    made = _variants(spark, folder)
    entities = F.array(
        en.entity("subpoi", F.col("standard_address")), en.entity("houseno", F.col("enterprise_address")),
        en.entity("subpoi", F.col("number").cast("string")),
    )
    fixed = en.retag_by_suffix(entities)
    return made.select("c_custkey", F.array_join(F.transform(fixed, lambda e: e["tag"]), ",").alias("tags"))


@query
def tag_native_17(spark, folder):
    """The native tagger over generated addresses of every customer."""
    return tagging.tag_addresses(_variants(spark, folder), "standard_address", "17", "c_custkey", LevelWordTagger())


@query
def tag_native_12(spark, folder):
    return tagging.tag_addresses(_variants(spark, folder), "standard_address", "12", None, LevelWordTagger())


@query
def tag_native_17_2(spark, folder):
    tagged = tagging.tag_addresses(_variants(spark, folder), "standard_address", "17_2", "c_custkey", LevelWordTagger())
    return tagged.drop("dom_json")


def _entities(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[en.entity(tag, text) for tag, text in pairs])


def _told(entities: Column | str) -> Column:
    return F.array_join(F.transform(entities, lambda e: F.concat_ws(":", e["tag"], e["text"])), "|")


def _numbers(spark, folder) -> DataFrame:
    """Every customer's number ``k`` and the same as text."""
    keys = v.table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    return v.spread(spark, keys).withColumn("n", F.col("k").cast("string"))


@query
def rule_merge(spark, folder):
    """Neighbouring rooms become one; others stay."""
    k, n = F.col("k") % 4, F.col("n")
    made = (
        F.when(k == 0, _entities(("roadno", n), ("houseno", F.lit("A")), ("houseno", n)))
        .when(k == 1, _entities(("houseno", n), ("road", F.lit("路")), ("houseno", F.lit("B"))))
        .when(k == 2, _entities(("houseno", n), ("houseno", F.lit("-")), ("houseno", F.lit("C"))))
        .otherwise(en.no_entities())
    )
    df = en.merge_adjacent(_numbers(spark, folder).withColumn("entities", made.cast(en.ENTITIES)))
    return df.select("k", _told("entities").alias("entities"))


@query
def rule_tail(spark, folder):
    """What no entity covers at the end of the address goes to the room."""
    k, n = F.col("k"), F.col("n")
    tails = F.array(*[F.lit(x) for x in ("", "601室", " a 12", "xyz", "三栋8铺", "大厦1203", "B座 7号 ", "12345")])
    road = F.concat(F.lit("路"), n, F.lit("号"))
    room = _entities(("road", F.lit("路")), ("houseno", F.concat(n, F.lit("号"))))
    plain = _entities(("road", F.lit("路")), ("roadno", F.concat(n, F.lit("号"))))
    df = _numbers(spark, folder).withColumns({
        "address": F.concat(road, F.element_at(tails, (k % 8 + 1).cast("int"))),
        "entities": F.when(k % 16 < 8, plain).otherwise(room).cast(en.ENTITIES),
    })
    return en.absorb_tail(df).select("k", _told("entities").alias("entities"))


@query
def rule_floor(spark, folder):
    """The floor of a room number, and the bare ground floor."""
    room, k = ((F.col("k") * 7) % 1900 + 50).cast("string"), F.col("k") % 3
    made = (
        F.when(k == 0, _entities(("houseno", room)))
        .when(k == 1, _entities(("houseno", F.lit("A")), ("houseno", F.concat(room, F.lit("室")))))
        .otherwise(_entities(("floorno", F.lit(" 首")), ("houseno", room)))
    )
    df = en.imply_floor(_numbers(spark, folder).withColumn("entities", made.cast(en.ENTITIES)))
    return df.select("k", _told("entities").alias("entities"))


@query
def rule_boundary(spark, folder):
    """Letters and digits before a room or a bare number word, and the end of the address."""
    k, n, road = F.col("k") % 5, F.col("n"), F.lit("科技路")
    address = (
        F.when(k == 0, F.concat(road, n, F.lit("室"))).when(k == 1, F.concat(road, n, F.lit("号")))
        .when(k == 2, F.concat(road, F.lit("8号601"))).when(k == 3, F.concat(road, F.lit("8号A座 601室")))
        .otherwise(F.concat(road, F.lit("（"), n, F.lit("）室")))
    )
    made = (
        F.when(k.isin(0, 4), _entities(("road", road), ("houseno", F.lit("室"))))
        .when(k == 1, _entities(("road", road), ("roadno", F.lit("号"))))
        .when(k == 2, _entities(("road", road), ("roadno", F.lit("8号"))))
        .otherwise(_entities(("roadno", F.lit("8号")), ("houseno", F.lit("A座"))))
    )
    df = _numbers(spark, folder).withColumns({"address": address, "entities": made.cast(en.ENTITIES)})
    return en.expand_boundaries(df).select("k", _told("entities").alias("entities"))


def _fill_stats(spark, folder, mode: str, fields: tuple[str, ...]) -> DataFrame:
    rows = stats.fill_stats(v.tagged_documents(spark, folder, mode), fields)
    return rows.withColumns(_r6(*[c for c in rows.columns if c.endswith("_rate")]))


@query
def tag_fill_stats(spark, folder):
    return _fill_stats(spark, folder, "12", vocab.FIELDS_12)


@query
def tag_fill_stats_17(spark, folder):
    return _fill_stats(spark, folder, "17", vocab.FIELDS_17)


@query
def tag_fill_stats_17_2(spark, folder):
    return _fill_stats(spark, folder, "17_2", vocab.FIELDS_34)


@query
def tag_filter_page(spark, folder):
    tagged = v.tagged_documents(spark, folder, "12").select("_id_field", *vocab.FIELDS_12, "original_address")
    kept = {"keyword": "an", "has_province": True, "has_city": True, "has_district": True}
    return pages.tagged_page(tagged, kept, "12", 2, 20)


@query
def tag17_filter(spark, folder):
    tagged = v.tagged_documents(spark, folder, "17").drop("dom_json")
    return tagged.where(filters.tagged_filter({"keyword": "th", "has_province": True}, "17"))


def _tagged_by_text(spark, folder) -> DataFrame:
    return v.tagged_documents(spark, folder, "17").withColumn("_id_field", F.lit(""))


@query
def tag_copy_left(spark, folder):
    """Benchmark, conversation and document texts with the tags of equal documents."""
    return copies.with_tags(_all_texts(spark, folder), "text", _tagged_by_text(spark, folder), "17").drop("dom_json")


@query
def tag_copy_12(spark, folder):
    tagged = v.tagged_documents(spark, folder, "12").withColumn("_id_field", F.lit(""))
    return copies.with_tags(_all_texts(spark, folder), "text", tagged, "12", blank_unmatched=True)


@query
def tag_copy_17_2(spark, folder):
    tagged = v.tagged_documents(spark, folder, "17_2").withColumn("_id_field", F.lit(""))
    return copies.with_tags(_all_texts(spark, folder), "text", tagged, "17_2", blank_unmatched=True)


@query
def copy_page(spark, folder):
    return pages.page(tag_copy_blank(spark, folder), ["text_id"], 7, 15)


@query
def tag_copy_blank(spark, folder):
    return copies.with_tags(
        _all_texts(spark, folder), "text", _tagged_by_text(spark, folder), "17", blank_unmatched=True
    )


def _all_texts(spark, folder) -> DataFrame:
    def rows(name: str, key: Column) -> DataFrame:
        return v.table(spark, folder, name).select(
            F.concat(F.lit(name + " "), key.cast("string")).alias("text_id"), "text"
        )

    return checks.all_addresses(
        rows("documents", F.col("doc_id")), rows("benchmark", F.col("item_id")),
        rows("conversations", F.concat_ws("-", "conv_id", "turn")),
    )


@query
def tag_sink_rows(spark, folder):
    """Stored layout of the 34-column form with NULL fields as ''."""
    tagged = v.tagged_documents(spark, folder, "17_2").withColumn("prov", F.nullif("prov", F.lit(""))).drop("poi_2")
    return tables.tagged_rows(tagged, "17_2").select("_id_field", "prov", "poi", "poi_2", "city_2")


# -- vectors ------------------------------------------------------------------------------------

@query
def encode_text(spark, folder):
    encoded = v.encoded_enterprise_texts(spark, folder)
    return encoded.select("source_id", "enterprise_name", "address", vectors.vector_text(F.col("vector")).alias("vector_text"))


@query
def encode_documents(spark, folder):
    encoded = v.encoded_standard_texts(spark, folder)
    return encoded.select(
        "source_id", "room_no",
        F.round(vectors.l2_norm(F.col("vector")), 6).alias("norm"),
        F.round(F.array_max("vector").cast("double"), 6).alias("largest"),
        F.size(F.filter("vector", lambda x: x > 0)).cast("long").alias("filled"),
    )


@query
def l2_normalize(spark, folder):
    doubled = F.transform("vector", lambda x: x.cast("double") * 2 + 1)
    unit = vectors.l2_normalize(doubled)
    return v.reference_vectors(spark, folder).select(
        "source_id", F.round(vectors.l2_norm(unit), 5).alias("norm"),
        F.round(F.get(unit, F.lit(0)).cast("double"), 5).alias("first_number"),
    )


@query
def vector_norm_check(spark, folder):
    """Unit vectors pass; the same vectors moved by 0.03 per number do not all."""
    moved = v.reference_vectors(spark, folder).withColumn(
        "vector", F.transform("vector", lambda x: (x * 1.05 + 0.03).cast("float"))
    )
    return checks.off_norm(moved).withColumns(_r6("norm"))


@query
def vector_self_product(spark, folder):
    rows = v.reference_vectors(spark, folder)
    return rows.agg(F.count("*").alias("n"), F.count_if(vectors.self_product_ok(F.col("vector"))).alias("ok"))


@query
def vector_profile(spark, folder):
    return stats.vector_profile(v.reference_vectors(spark, folder)).drop("created_at", "columns")


@query
def same_address_check(spark, folder):
    found = checks.same_address_similarity(v.query_vectors(spark, folder), v.reference_vectors(spark, folder))
    return found.withColumns(_r6("similarity"))


def _stored(spark, folder) -> DataFrame:
    return v.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("source_id"))


@query
def unvectorized_anti(spark, folder):
    return pending.unvectorized(v.standard_texts(spark, folder), _stored(spark, folder))


@query
def unvectorized_enterprise(spark, folder):
    """Query side: name, too, and the id as name where there is none."""
    addresses = tables.query_addresses(v.table(spark, folder, "documents"), "doc_id", None, "text")
    return pending.unvectorized(addresses, _stored(spark, folder)).select("id", "name")


@query
def unvectorized_count(spark, folder):
    return pending.unvectorized_count(v.standard_texts(spark, folder), _stored(spark, folder))


@query
def valid_count(spark, folder):
    return pending.valid_count(v.turn_pairs(spark, folder), "next_text")


@query
def vectorize_stream(spark, folder):
    """Conversation turns as an arriving file, encoded and appended."""
    target, state = v.work_folder(spark, "vectors"), v.work_folder(spark, "state")
    schema = v.table(spark, folder, "conversations").schema
    turns = incremental.arriving(spark, f"{folder}/conversations.parquet*", schema)
    addresses = tables.query_addresses(turns.withColumn("id", F.concat_ws("-", "conv_id", "turn")), "id", "role", "text")
    incremental.vectorize_stream(addresses, target, "enterprise", CharPairEncoder(v.TEXT_DIM), state).awaitTermination()
    stored = spark.read.parquet(target)
    return stored.select("source_id", "enterprise_name", "address", vectors.vector_text(F.col("vector")).alias("vector_text"))


@query
def vectorize_stream_lists(spark, folder):
    """Indexes of both kinds over the users' turns, then all turns as an arriving file: every id is stored once, in the
    list of its nearest centre."""
    schema = v.table(spark, folder, "conversations").schema
    encoder = CharPairEncoder(v.TEXT_DIM)
    out = []
    for kind, extra, name in (("enterprise", "enterprise_name", "name"), ("standard", "room_no", "room_no")):
        target, state = v.work_folder(spark, "index"), v.work_folder(spark, "state")

        def addresses(turns):
            rows = tables.query_addresses(turns.withColumn("id", F.concat_ws("-", "conv_id", "turn")), "id", "role", "text")
            return rows.withColumnRenamed("name", name)

        first = addresses(v.table(spark, folder, "conversations").where("role = 'user'"))
        stored = tables.vector_rows(vectorize.encode(first, kind, encoder), kind)
        centres = v.given_centres(stored.withColumn("source_id", F.split("source_id", "-")[0]), 8)
        vectorize.publish(stored, target, centres=centres)
        turns = incremental.arriving(spark, f"{folder}/conversations.parquet*", schema)
        incremental.vectorize_stream(addresses(turns), target, kind, encoder, state).awaitTermination()
        found = knn.assign_cells(tables.read(spark, target), centres)
        out.append(found.select(
            F.lit(kind).alias("kind"), "source_id", F.col(extra).alias("said_by"), "address", F.size("vector").cast("long").alias("dim"),
            (F.col("list_id") == F.col("cell")).alias("listed"),
        ))
    return out[0].unionByName(out[1])


@query
def tag_stream(spark, folder):
    """Document texts as an arriving file, tagged by the native tagger."""
    target, state = v.work_folder(spark, "tagged"), v.work_folder(spark, "state")
    schema = v.table(spark, folder, "documents").schema
    rows = incremental.arriving(spark, f"{folder}/documents.parquet*", schema)
    incremental.tag_stream(rows, "text", target, "17", "doc_id", None, state).awaitTermination()
    return spark.read.parquet(target).drop("created_at")


@query
def stream_progress(spark, folder):
    """What a stream over all documents reports when it is done."""
    target, state = v.work_folder(spark, "tagged"), v.work_folder(spark, "state")
    documents = v.table(spark, folder, "documents")
    rows = incremental.arriving(spark, f"{folder}/documents.parquet*", documents.schema)
    query = incremental.tag_stream(rows, "text", target, "17", "doc_id", None, state)
    query.awaitTermination()
    told = incremental.progress(query, documents.count())
    row = [(told["processed"], told["total"], float(told["progress"]), told["rate"] > 0)]
    return spark.createDataFrame(row, "processed long, total long, progress double, has_rate boolean")


@query
def plugged_failures(spark, folder):
    """A model that fails on some turns: their reasons beside the other rows' scores."""

    def load():
        def run(a: list[str], b: list[str]) -> list[tuple[float, float, float]]:
            if any(x.startswith("T") for x in a):
                raise ValueError("starts with T")
            return [(0.25, 0.25, 0.5)] * len(a)

        return run

    scored = pairs.match_pairs(v.turn_pairs(spark, folder), "text", "next_text", "id", PluggedPairScorer(load))
    return scored.select("identifier", "exact_match", "partial_match", "not_match", "match_status", "error")


@query
def plugged_batches(spark, folder):
    """A model that is shown every document in batches of like length; what it saw beside each."""

    def load():
        return lambda texts: [[float(len(t or "")), float((t or "").count(" "))] for t in texts]

    rows = v.table(spark, folder, "documents").select("doc_id", "text")
    seen = PluggedEncoder(load, "text", "seen", batch_rows=64).transform(rows)
    return seen.select("doc_id", *[F.element_at("seen", i).cast("long").alias(n) for i, n in ((1, "n_chars"), (2, "n_spaces"))], "error")


@query
def rank_repeated_ids(spark, folder):
    """Queries that share an id, three orders each, keep their own verdicts."""
    shared = F.floor(F.col("enterprise_id").cast("long") / 3).cast("string")
    recalled = v.recall_rows(spark, folder).withColumn("enterprise_id", shared)
    queries = v.all_enterprises(spark, folder).withColumn("enterprise_id", shared)
    return _rounded(match.rank_recall(recalled, SimilarityScorer(), "rounded", 0.5, queries))


@query
def vectorize_incremental(spark, folder):
    """A full run over the suppliers' names, then an incremental one over the
    customers': stored ids keep their rows, the other ids are added."""
    target = v.work_folder(spark, "vectors")
    names = lambda t, k, n: v.table(spark, folder, t).select(
        F.col(k).cast("string").alias("id"), F.col(n).alias("address"), F.lit("").alias("room_no")
    )
    encoder = CharPairEncoder(v.TEXT_DIM)
    vectorize.vectorize(names("supplier", "s_suppkey", "s_name"), target, "standard", encoder)
    vectorize.vectorize_new(names("customer", "c_custkey", "c_name"), target, "standard", encoder)
    return spark.read.parquet(target).select("source_id", "address", F.size("vector").cast("long").alias("dim"))


@query
def vectorize_repeated_ids(spark, folder):
    """Customers by nation: an id occurs many times, and every row is stored."""
    target = v.work_folder(spark, "vectors")
    rows = v.table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("string").alias("id"), F.col("c_name").alias("address"), F.lit("").alias("room_no")
    )
    vectorize.vectorize(rows, target, "standard", CharPairEncoder(v.TEXT_DIM))
    return spark.read.parquet(target).select("source_id", "address", F.size("vector").cast("long").alias("dim"))


# -- whole pipelines ----------------------------------------------------------------------------

@query
def two_stage_match(spark, folder):
    """Conversation turns against documents: encode, recall, score, choose."""
    found = match.two_stage(
        v.enterprise_text_vectors(spark, folder), v.standard_text_vectors(spark, folder),
        top_n=3, threshold=0.5, scorer=LogitPairScorer(), keep_unmatched=True,
    )
    return _rounded(found)


@query
def two_stage_lists(spark, folder):
    """The stored pipeline over an index: vectors by list, recall over some lists, ranking."""
    at = {n: v.work_folder(spark, n) for n in ("queries", "index", "recall", "match")}
    tables.replace(tables.vector_rows(v.query_vectors(spark, folder), "enterprise"), at["queries"])
    references = v.reference_vectors(spark, folder)
    vectorize.index(tables.vector_rows(references, "standard"), at["index"], centres=v.given_centres(references, 16))
    match.run_two_stage(
        spark, at["queries"], at["index"], at["recall"], at["match"], top_n=5, scorer=SimilarityScorer(), probes=4,
        rank_threshold=0.5, keep_unmatched=True,
    )
    return _rounded(tables.read(spark, at["match"]).drop("created_at"))


@query
def text_recall(spark, folder):
    found = match.recall(
        v.enterprise_text_vectors(spark, folder), v.standard_text_vectors(spark, folder), top_n=3, threshold=0.5
    )
    return found.select("enterprise_id", "standard_id", "room_no", F.round("similarity", 6).alias("similarity"))


@query
def single_stage_match(spark, folder):
    found = match.single_stage(
        v.enterprise_texts(spark, folder), v.standard_text_vectors(spark, folder), top_n=3,
        encoder=CharPairEncoder(v.TEXT_DIM), scorer=SimilarityScorer(), rank_threshold=0.6,
    )
    return _rounded(found)


# -- checks and set operations ------------------------------------------------------------------

@query
def dup_semi(spark, folder):
    return checks.repeated(v.table(spark, folder, "documents"), "text").select("doc_id", "lang", "n_chars")


@query
def dup_counts(spark, folder):
    return stats.duplicate_counts(v.table(spark, folder, "documents"), "text", "source", "lang")


@query
def overlap_intersect(spark, folder):
    return checks.overlap(v.place_names(spark, folder, "customer"), v.place_names(spark, folder, "supplier"))


@query
def union_distinct(spark, folder):
    return checks.distinct_addresses(v.place_names(spark, folder, "customer"), v.place_names(spark, folder, "supplier"))


@query
def union_all(spark, folder):
    both = checks.all_addresses(v.place_names(spark, folder, "customer"), v.place_names(spark, folder, "supplier"))
    return both.groupBy("address").agg(F.count("*").alias("n"))


@query
def distractor_except(spark, folder):
    return checks.unused(v.place_names(spark, folder, "supplier"), v.place_names(spark, folder, "customer"), "address")


@query
def class_distribution(spark, folder):
    return stats.distribution(v.table(spark, folder, "labels"), "quality", "toxic")


def _variants(spark, folder) -> DataFrame:
    places = v.customer_places(spark, folder)
    return evaluation.write_variants(places, F.pmod("c_custkey", F.lit(20)))


@query
def eval_pairs(spark, folder):
    """Two spellings of every customer's place, by twenty kinds of difference."""
    return evaluation.evaluation_rows(_variants(spark, folder), F.col("c_custkey") + 1)


@query
def eval_distractors(spark, folder):
    """A distractor per customer that is no address of the pairs."""
    places = v.customer_places(spark, folder).withColumn("number", F.col("c_custkey") * 7 + 501)
    made = evaluation.write_distractors(places, F.col("c_custkey"))
    return evaluation.distractor_rows(made, F.col("c_custkey"), _variants(spark, folder))


def _gazetteer_pairs(spark, folder) -> tuple[DataFrame, int]:
    """A gazetteer of the nations, and as many pairs as there are customers."""
    return v.gazetteer(spark, folder), v.table(spark, folder, "customer").count()


@query
def eval_match_pairs(spark, folder):
    return evaluation.match_pairs(*_gazetteer_pairs(spark, folder))


@query
def eval_distractor_rows(spark, folder):
    """As many distractors as pairs, whatever addresses the pairs use up."""
    places, count = _gazetteer_pairs(spark, folder)
    return evaluation.distractors(places, evaluation.match_pairs(places, count), count)


@query
def eval_accuracy(spark, folder):
    """The native scorer on pairs of all three classes."""
    made = evaluation.labelled_pairs(*_gazetteer_pairs(spark, folder))
    judged = pairs.match_pairs(made, "address_a", "address_b", "expected_match")
    return evaluation.accuracy(judged.withColumnRenamed("identifier", "expected_match")).withColumns(_r6("right_rate"))


@query
def eval_samples(spark, folder):
    return pages.page(eval_pairs(spark, folder), ["group_id"], 3, 10)


@query
def preview_rows(spark, folder):
    return tables.preview(v.table(spark, folder, "customer").select("c_custkey", "c_name"), 5, "c_custkey")


@query
def list_rule(spark, folder):
    rows = v.table(spark, folder, "customer").select((F.col("c_custkey") * 20011).alias("n"))
    return rows.select("n", knn.list_count(F.col("n")).alias("lists"))


@query
def eval_transform_counts(spark, folder):
    return stats.distribution(_variants(spark, folder), "transform_type")


@query
def eval_pair_status(spark, folder):
    """The native pair scorer on the generated pairs."""
    made = evaluation.evaluation_rows(_variants(spark, folder), F.col("c_custkey") + 1)
    judged = pairs.match_pairs(made, "enterprise_address", "standard_address", "enterprise_id")
    return judged.groupBy("match_status").agg(F.count("*").alias("n"))


@query
def eval_verify(spark, folder):
    made = evaluation.evaluation_rows(_variants(spark, folder), F.col("c_custkey") + 1)
    queries = made.select(F.col("enterprise_id").alias("source_id"), F.col("enterprise_address").alias("address"))
    references = made.select(F.col("standard_addr_code").alias("source_id"), F.col("standard_address").alias("address"))
    return evaluation.verify(queries, references)


@query
def prefix_count(spark, folder):
    return filters.count_like(
        v.table(spark, folder, "customer"), "c_name", {"all_count": "Customer%", "ones_count": "%1", "fifties": "%#_%5_"}
    )


@query
def without_prefix(spark, folder):
    return filters.without_like(v.table(spark, folder, "customer"), "c_name", "Customer#_______1%").select("c_custkey", "c_name")


# -- logs, tags, files ----------------------------------------------------------------------------

def _log(spark, folder) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARNING").otherwise("INFO")
    return v.table(spark, folder, "events").select(
        F.col("event_id").alias("id"), level.alias("level"), F.col("props").alias("message"), F.col("ts").alias("created_at")
    )


@query
def log_stored(spark, folder):
    return logs.stored(_log(spark, folder)).select("id", "level", "message")


@query
def log_latest(spark, folder):
    return logs.latest(logs.stored(_log(spark, folder)), 200).select("id", "level", "message")


@query
def log_latest_errors(spark, folder):
    return logs.latest(logs.stored(_log(spark, folder)), 50, "ERROR").select("id", "level", "message")


@query
def prefix_ascii(spark, folder):
    return v.table(spark, folder, "events").select("event_id", prefixes.tag_prefix(F.col("props")).alias("prefix"))


@query
def prefix_cjk(spark, folder):
    tag = F.concat(F.lit(" 福田渝-"), "c_name")
    prefix = prefixes.tag_prefix(tag)
    return v.table(spark, folder, "customer").select(
        "c_custkey", prefix.alias("prefix"), *[c.alias(n) for n, c in prefixes.tag_tables(prefix).items()]
    )


@query
def schema_align(spark, folder):
    """Orders as an old match table: real scores, no correction source."""
    old = v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("enterprise_id"), F.col("o_orderpriority").alias("enterprise_name"),
        F.col("o_orderstatus").alias("match_status"), (F.col("o_totalprice") / 1e6).cast("float").alias("exact_match"),
    )
    return schemas.align(old, schemas.MATCH, schemas.MATCH_DEFAULTS).drop("created_at").withColumns(_r6("exact_match"))


@query
def null_and_blank(spark, folder):
    turns = v.turn_pairs(spark, folder)
    return turns.select(
        "id", tx.strip(tx.as_text(F.col("next_text"))).alias("stripped"),
        tx.null_if_empty(tx.as_text(F.col("next_text"))).alias("nulled"),
    )


@query
def csv_round_trip(spark, folder):
    """Customers exported in pieces with a header and a mark, and read again."""
    target = v.work_folder(spark, "export")
    customers = v.table(spark, folder, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))
    csv.write_csv(customers, target, vocab.EXPORT_ROWS, byte_order_mark=True)
    return csv.read_csv(spark, f"{target}/*.csv", "c_custkey", "c_name")


@query
def csv_encodings(spark, folder):
    """Customers by thirds in three encodings, recognized and read as one table."""
    target = v.work_folder(spark, "encodings")
    third = F.col("c_custkey") % 3
    rare = F.when(third == 2, "㐀").otherwise("路")  # not in the smaller code pages
    rows = v.table(spark, folder, "customer").select("c_custkey", F.concat(F.lit("科苑"), rare, "c_custkey", F.lit("号")).alias("address"))
    for i, encoding in enumerate(("utf-8", "gbk", "gb18030")):
        csv.write_csv(rows.where(third == i), f"{target}/{encoding}", encoding=encoding)
    return csv.read_csv(spark, f"{target}/*/*.csv", "c_custkey", "address")


@query
def match_export(spark, folder):
    """Filtered match rows as CSV, read again."""
    target = v.work_folder(spark, "match-export")
    csv.write_csv(pages.match_rows(_corrected(spark, folder), MATCH_FILTERS), target, vocab.EXPORT_ROWS)
    read = spark.read.option("header", True).option("escape", '"').csv(target)
    scores = {c: F.round(F.col(c).cast("double"), 6) for c in ("exact_match", "partial_match", "not_match")}
    return read.withColumns(scores).withColumn("room_no", F.coalesce("room_no", F.lit("")))


@query
def tags_lifecycle(spark, folder):
    """A tag per region in a database of its own; those of an even key are deleted again."""
    regions = v.table(spark, folder, "region").orderBy("r_regionkey").collect()
    before, place = spark.catalog.currentDatabase(), v.work_folder(spark, "tags")
    database = f"tags_{place.rpartition('-')[2]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{place}'")
    spark.catalog.setCurrentDatabase(database)
    try:
        for r in regions:
            tags.create_tag(spark, f" {r['r_name']} ")
        for r in regions[::2]:
            tags.delete_tag(spark, tags.find_tag(spark, r["r_name"].lower().replace(" ", "_"))["prefix"])
        return tags.all_tags(spark).select("tag_name", "prefix", "recall_table", "match_table")
    finally:
        spark.catalog.setCurrentDatabase(before)


@query
def csv_statistics(spark, folder):
    target = v.work_folder(spark, "statistics")
    csv.write_statistics(match_stats(spark, folder), target)
    read = spark.read.option("header", True).csv(target)
    return read.select(F.col("total_count").cast("long"), F.round(F.col("match_rate").cast("double"), 6).alias("match_rate"))
