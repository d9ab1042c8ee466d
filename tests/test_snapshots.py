"""Published versions: replacing, extending and correcting stored tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from addrloom import schemas
from addrloom.models.encoder import CharPairEncoder
from addrloom.operators import copies, knn
from addrloom.operators import corrections as co
from addrloom.plans import corrections, match, vectorize
from addrloom.sources import snapshots, tables
from addrloom.streaming import incremental


def files(df):
    return set(df.inputFiles())


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=str)


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "table")


def numbers(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("v"))


def test_a_table_replaced_from_itself(spark, path):
    assert not snapshots.is_snapshots(spark, path)
    snapshots.publish(numbers(spark, 100), path, "k", 8)
    snapshots.publish(snapshots.read(spark, path).where("v >= 500").withColumn("v", F.col("v") + 1), path, "k", 8)
    want = sorted(((str(i), 10 * i + 1) for i in range(50, 100)), key=str)
    assert rows_of(snapshots.read(spark, path)) == want == rows_of(tables.read(spark, path, "k", "v"))
    assert snapshots.read(spark, path, 1).count() == 100  # still there for who reads it
    assert rows_of(snapshots.versions(spark, path).select("version", "rows")) == [(1, 100), (2, 50)]
    assert snapshots.vacuum(spark, path) == 1
    assert rows_of(snapshots.read(spark, path)) == want
    with pytest.raises(ValueError, match="no version 1"):
        snapshots.read(spark, path, 1)


def test_a_failing_write_leaves_the_old_version(spark, path):
    snapshots.publish(numbers(spark, 40), path, "k", 4)
    torn = numbers(spark, 40).withColumn("v", F.when(F.col("v") == 390, F.raise_error("broken").cast("long")).otherwise(0))
    for step in (lambda: snapshots.publish(torn, path, "k", 4), lambda: snapshots.append(torn, path),
                 lambda: snapshots.rewrite(spark, path, numbers(spark, 40), lambda rows: torn)):
        with pytest.raises(Exception, match="broken"):
            step()
        assert rows_of(snapshots.read(spark, path)) == rows_of(numbers(spark, 40))
        assert snapshots.version(spark, path).number == 1
    assert snapshots.vacuum(spark, path) == 0 or snapshots.read(spark, path).count() == 40


def test_empty_and_odd_tables(spark, path):
    snapshots.publish(numbers(spark, 0), path, "k", 4)
    assert snapshots.read(spark, path).collect() == [] and snapshots.read(spark, path).schema == numbers(spark, 0).schema
    odd = spark.createDataFrame([(None, 1), ("a", None), ("a", None)], "k string, v long")
    snapshots.append(odd, path)
    assert rows_of(snapshots.read(spark, path)) == rows_of(odd)
    assert rows_of(snapshots.read(spark, path, keys=spark.createDataFrame([(None,)], "x string")).where("k is null")) == [(None, 1)]
    with pytest.raises(ValueError):
        snapshots.publish(odd.withColumn("_cell", F.lit(1)), path)
    with pytest.raises(ValueError):
        snapshots.publish(odd.select("k", "k"), path)
    plain = path + "_plain"
    snapshots.publish(odd, plain)
    with pytest.raises(ValueError, match="without a key"):
        snapshots.rewrite(spark, plain, odd, lambda rows: rows)


def test_two_writers(spark, path):
    """Of two that begin from one version the first counts; one that died holding a number stops nobody."""
    snapshots.publish(numbers(spark, 10), path, "k", 2)

    def slow(rows):
        snapshots.append(numbers(spark, 1), path)  # another writer is faster
        return rows

    with pytest.raises(RuntimeError, match="another writer"):
        snapshots.rewrite(spark, path, numbers(spark, 10), slow)
    assert snapshots.read(spark, path).count() == 11
    at = snapshots.version(spark, path)
    files, claim = snapshots._hadoop(spark, f"{path}/claims/{at.number + 1}")
    assert files.createNewFile(claim)
    assert snapshots.append(numbers(spark, 1), path).number == at.number + 2 and snapshots.read(spark, path).count() == 12
    snapshots.vacuum(spark, path)
    assert snapshots.append(numbers(spark, 1), path).rows == 13


def matches(spark, n=200):
    return spark.range(n).select(
        F.col("id").cast("string").alias("enterprise_id"), F.concat(F.lit("firm "), "id").alias("enterprise_name"), F.lit("road").alias("enterprise_address"),
        F.concat(F.lit("a"), "id").alias("address_id"), F.lit("place").alias("standard_address"), F.lit("").alias("room_no"),
        F.lit(0.2).alias("partial_match"), F.lit(0.3).alias("exact_match"), F.lit(0.5).alias("not_match"),
        F.lit("x").alias("match_status"), F.lit("automatic").alias("correction_source"),
    )


def test_merge_rewrites_only_the_cells_it_touches(spark, path):
    corrections.store_matches(matches(spark), path, 32)
    before = files(snapshots.read(spark, path))
    picks = spark.createDataFrame(
        [("3", "s1", "new", "r", 1), ("3", "s2", "newer", "r", 2), ("77", "s3", "other", None, 3), ("nobody", "s", "p", "r", 4)],
        "enterprise_id string, standard_id string, standard_address string, room_no string, at int",
    )
    corrections.merge_picks(spark, path, picks, "at")
    after = snapshots.read(spark, path)
    want = co.apply_picks(tables.match_rows(matches(spark)), picks, "at")
    columns = [c for c in want.columns if c != "created_at"]
    assert rows_of(after, *columns) == rows_of(want, *columns)
    kept = before & files(after)
    assert len(before - files(after)) <= 3 and len(kept) >= 29
    # edits, given twice under one token
    edits = spark.createDataFrame([("5", None, "edited", None)], "enterprise_id string, address_id string, standard_address string, room_no string")
    one = corrections.merge_edits(spark, path, edits, token="monday")
    two = corrections.merge_edits(spark, path, edits.withColumn("standard_address", F.lit("again")), token="monday")
    assert one.number == two.number
    row = snapshots.read(spark, path).where("enterprise_id = '5'").first()
    assert (row["standard_address"], row["address_id"], row["exact_match"]) == ("edited", "a5", 1.0)
    assert corrections.merge_edits(spark, path, edits.limit(0)).number == one.number


def addresses(spark, ids, kind, word="street"):
    rest = "name" if kind == "enterprise" else "room_no"
    return spark.createDataFrame([(str(i), f"n{i}", f"{word} number {i} of {i % 7}") for i in ids], f"id string, {rest} string, address string")


@pytest.mark.parametrize("kind", ["enterprise", "standard"])
@pytest.mark.parametrize("lists", [None, 3])
def test_extend(spark, path, kind, lists):
    encoder = CharPairEncoder(32)
    vectorize.publish(tables.vector_rows(vectorize.encode(addresses(spark, range(20), kind), kind, encoder), kind), path, lists, cells=16)
    added = vectorize.extend(addresses(spark, range(15, 30), kind, "lane"), path, kind, encoder, "one")
    assert sorted(int(r["source_id"]) for r in added.collect()) == list(range(20, 30))
    # the same step again, as after a failure between its two tables or after it
    assert vectorize.extend(addresses(spark, range(15, 30), kind, "lane"), path, kind, encoder, "one").count() == 10
    stored = tables.read(spark, path)
    assert sorted(int(r["source_id"]) for r in stored.collect()) == list(range(30))
    if lists:
        centres = knn.load_centres(spark, vectorize.centres_path(path))
        again = knn.assign_cells(stored, centres)
        assert again.where("cell <> list_id").count() == 0
        assert sorted(int(r["source_id"]) for r in tables.read(spark, vectorize.ids_path(path)).collect()) == list(range(30))
    # ids of one cell are looked up in the files of that cell alone
    registry = vectorize.ids_path(path) if lists else path
    few = snapshots.read(spark, registry, keys=spark.createDataFrame([("3",)], "id string"))
    assert few.where("source_id = '3'").count() == 1 and len(files(few)) < len(files(tables.read(spark, registry))) / 3


def test_a_step_that_died_between_its_tables(spark, path):
    encoder = CharPairEncoder(32)
    first = tables.vector_rows(vectorize.encode(addresses(spark, range(9), "standard"), "standard", encoder), "standard")
    vectorize.publish(first, path, 2, cells=8)
    fresh = tables.vector_rows(vectorize.encode(addresses(spark, range(9, 12), "standard"), "standard", encoder), "standard")
    snapshots.append(knn.with_list_id(fresh, knn.load_centres(spark, vectorize.centres_path(path))), path, "b")
    vectorize.extend(addresses(spark, range(5, 12), "standard"), path, "standard", encoder, "b")
    for table in (path, vectorize.ids_path(path)):
        assert sorted(int(r["source_id"]) for r in tables.read(spark, table).collect()) == list(range(12))


@pytest.mark.parametrize("kind", ["enterprise", "standard"])
@pytest.mark.parametrize("target", ["published", "published index", "folder index", "folder", "new"])
def test_streams_lose_no_row(spark, tmp_path, kind, target):
    encoder, path, arrive = CharPairEncoder(32), str(tmp_path / "target"), str(tmp_path / "arrive")
    vectors = tables.vector_rows(vectorize.encode(addresses(spark, range(20), kind), kind, encoder), kind)
    if target.startswith("published"):
        vectorize.publish(vectors, path, 3 if "index" in target else None, cells=8)
    elif target != "new":
        vectorize.vectorize(addresses(spark, range(20), kind), path, kind, encoder, 3 if "index" in target else None)
    for ids in (range(10, 40), range(30, 50)):
        addresses(spark, ids, kind).coalesce(1).write.mode("append").parquet(arrive)
    rows = incremental.arriving(spark, arrive, addresses(spark, [1], kind).schema, files_per_batch=1)
    incremental.vectorize_stream(rows, path, kind, encoder, str(tmp_path / "state")).awaitTermination()
    stored = tables.read(spark, path)
    assert sorted(int(r["source_id"]) for r in stored.collect()) == list(range(10 if target == "new" else 0, 50))
    assert stored.where("vector is null").count() == 0
    if "index" in target:
        assert knn.assign_cells(stored, knn.load_centres(spark, vectorize.centres_path(path))).where("cell <> list_id").count() == 0


def test_recall_over_a_published_index(spark, tmp_path):
    encoder = CharPairEncoder(32)
    at = {n: str(tmp_path / n) for n in ("q", "r", "out")}
    references = tables.vector_rows(vectorize.encode(addresses(spark, range(60), "standard"), "standard", encoder), "standard")
    vectorize.publish(references.where("cast(source_id as int) < 40"), at["r"], 4)
    vectorize.extend(addresses(spark, range(60), "standard"), at["r"], "standard", encoder)
    vectorize.publish(tables.vector_rows(vectorize.encode(addresses(spark, range(60), "enterprise"), "enterprise", encoder), "enterprise"), at["q"])
    match.run_recall(spark, at["q"], at["r"], at["out"], top_n=1, probes=4)
    best = {r["enterprise_id"]: r["similarity"] for r in tables.read(spark, at["out"]).collect()}
    assert len(best) == 60 and min(best.values()) > 0.999


def test_an_enterprise_folder_as_an_index(spark, path):
    vectorize.vectorize(addresses(spark, range(20), "enterprise"), path, "enterprise", CharPairEncoder(32), lists=3)
    assert spark.read.parquet(path).count() == 20 and "list_id" in spark.read.parquet(path).columns


def test_copies_keep_clashing_names(spark):
    source = spark.createDataFrame([("road 1", "mine", "s", "r", "x")], "address string, _key string, _s string, _r string, _a string")
    tagged = tables.tagged_rows(spark.createDataFrame([("road 1", "gd")], "original_address string, prov string"), "17")
    row = copies.with_tags(source, "address", tagged, "17").first()
    assert (row["_key"], row["_s"], row["_r"], row["prov"]) == ("mine", "s", "r", "gd")
    pairs = spark.createDataFrame([("road 1", "x", 0.9, 0.1, 0.0, "m")], "address_a string, address_b string, exact_match double, partial_match double, not_match double, match_status string")
    row = copies.with_pair_scores(source, "address", "_a", pairs).first()
    assert (row["_key"], row["_a"], row["exact_match"]) == ("mine", "x", 0.9)


def test_single_stage_shows_each_query_to_the_model_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class Counting(CharPairEncoder):
        def transform(self, df):
            def mark(batches):
                for b in batches:
                    seen.add(b.num_rows)
                    yield b

            return super().transform(df.mapInArrow(mark, df.schema))

    references = tables.vector_rows(vectorize.encode(addresses(spark, range(30), "standard"), "standard", CharPairEncoder(32)), "standard")
    out = match.single_stage(addresses(spark, range(25), "enterprise"), references, 1, Counting(32), rank_threshold=0.0)
    assert out.count() == 25 and seen.value == 25


def test_layouts_are_those_of_the_tables(spark, path):
    vectorize.publish(spark.createDataFrame([], schemas.VECTORS["standard"]), path)
    assert tables.read(spark, path).schema == schemas.VECTORS["standard"]
