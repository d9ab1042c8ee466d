"""Address tables to vector tables, whole or only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.models.encoder import CharPairEncoder
from addrloom.operators import centre_tree, knn
from addrloom.operators.pending import unvectorized
from addrloom.sources import snapshots, tables


def encode(addresses: DataFrame, kind: str, encoder=None) -> DataFrame:
    """Addresses (id, name or room, address) as rows of a vector table, one per row:
    an id given twice keeps both.  Rows the encoder fails on are left out (they stay
    pending); :func:`failed` lists them.  No shuffle."""
    extra = {"enterprise": F.col("name").alias("enterprise_name"), "standard": F.col("room_no")}[kind]
    rest = "enterprise_name" if kind == "enterprise" else "room_no"
    named = addresses.select(F.col("id").cast("string").alias("source_id"), extra, "address")
    encoded = (encoder or CharPairEncoder()).transform(named)
    return encoded.where("vector IS NOT NULL").select("source_id", rest, "address", "vector")


def failed(addresses: DataFrame, encoder) -> DataFrame:
    """``source_id``, ``address`` and ``error`` of the addresses a plugged encoder fails on."""
    named = addresses.select(F.col("id").cast("string").alias("source_id"), "address")
    return encoder.transform(named).where("vector IS NULL").select("source_id", "address", "error")


def centres_path(path: str) -> str:
    return f"{path.rstrip('/')}_centres"


def _fitted(vectors: DataFrame, lists: int | None, tree: bool):
    return centre_tree.fit_tree(vectors, lists or None) if tree else knn.fit_centres(vectors, lists or None)


def vectorize(
    addresses: DataFrame, path: str, kind: str, encoder=None, lists: int | None = None, tree: bool = False,
) -> None:
    """Full run: the vector table is replaced.

    With ``lists`` (0: by the number of rows) the table is also an index: its vectors are
    clustered, written under the ``list_id`` of their nearest centre, and the centres are
    stored beside it.  With ``tree`` the centres form a tree, for more lists than flat centres allow.
    """
    rows = tables.vector_rows(encode(addresses, kind, encoder), kind)
    if lists is None:
        tables.replace(rows, path)
    else:
        index(tables.written(rows, "vectors"), path, lists, tree=tree)


def index(vectors: DataFrame, path: str, lists: int = 0, centres=None, tree: bool = False) -> None:
    """A vector table as a list-partitioned one with its centres (fitted unless given)."""
    centres = _fitted(vectors, lists, tree) if centres is None else centres
    tables.replace(knn.with_list_id(vectors, centres), path, "list_id")
    knn.save_centres(vectors.sparkSession, centres, centres_path(path))


def vectorize_new(addresses: DataFrame, path: str, kind: str, encoder=None) -> None:
    """Incremental run: only ids that are not in the table are encoded and
    appended, so a stopped run is simply run again."""
    spark = addresses.sparkSession
    stored = spark.read.parquet(path)
    fresh = tables.vector_rows(encode(unvectorized(addresses, stored), kind, encoder), kind)
    if "list_id" in stored.columns:  # an index: new rows join the lists there are
        fresh = knn.with_list_id(fresh, knn.load_centres(spark, centres_path(path)))
    tables.append(fresh, path, "list_id" if "list_id" in stored.columns else None)


# -- published versions --------------------------------------------------------------------------

def ids_path(path: str) -> str:
    return f"{path.rstrip('/')}_ids"


def publish(
    vectors: DataFrame, path: str, lists: int | None = None, centres=None, cells: int = snapshots.CELLS, tree: bool = False,
) -> None:
    """Vector rows, of either kind, as a table of published versions that can be extended.

    Plain, its cells are those of the ids.  With ``lists`` (0: by the number of rows) or ``centres`` it is an index: cells of lists,
    the centres beside it, and the ids alone in a table of their own, in cells of the ids.
    """
    if lists is None and centres is None:
        snapshots.publish(vectors, path, "source_id", cells)
        return
    vectors = tables.written(vectors, "vectors")
    centres = _fitted(vectors, lists, tree) if centres is None else centres
    spark = vectors.sparkSession
    knn.save_centres(spark, centres, centres_path(path))
    listed = knn.with_list_id(vectors, centres)
    at = snapshots.publish(listed, path, "list_id", min(len(centres), snapshots.MOST_CELLS))
    snapshots.publish(snapshots.read(spark, path, at.number).select("source_id"), ids_path(path), "source_id", cells)


def extend(addresses: DataFrame, path: str, kind: str, encoder=None, token: str | None = None) -> DataFrame:
    """Encode the ids that a published vector table does not hold and append them; the rows that were added.

    Only the cells that the ids of ``addresses`` fall in are read to tell which are new.  In an index each new row joins the list of
    its nearest centre.  A ``token`` names the step; repeated after a failure anywhere in it, it counts once.
    """
    spark = addresses.sparkSession
    indexed = snapshots.is_snapshots(spark, ids_path(path))
    token = token or snapshots.new_token()
    if not snapshots.has(spark, path, token):
        # read more than once below
        addresses = tables.written(addresses, "arrived")
        known = snapshots.read(spark, ids_path(path) if indexed else path, keys=addresses.select(F.col("id").cast("string")))
        fresh = tables.vector_rows(encode(unvectorized(addresses, known), kind, encoder), kind)
        if indexed:
            fresh = knn.with_list_id(fresh, knn.load_centres(spark, centres_path(path)))
        snapshots.append(fresh, path, token)
    added = snapshots.read(spark, path, part=token)
    if indexed:
        snapshots.append(added.select("source_id"), ids_path(path), token)
    return added
