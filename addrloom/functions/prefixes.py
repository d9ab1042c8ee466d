"""Tag names to table-name prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions import text as tx
from addrloom.vocab import DEFAULT_PREFIX, MATCH_SUFFIX, RECALL_SUFFIX

# fixed values: readings of characters frequent in district names.  A fuller
# reading table is passed in as a parameter; characters found in neither become
# z<code point in hex>.
READINGS = {
    "福": "fu", "田": "tian", "罗": "luo", "湖": "hu", "南": "nan", "山": "shan",
    "宝": "bao", "安": "an", "龙": "long", "华": "hua", "岗": "gang", "盐": "yan",
    "坪": "ping", "光": "guang", "明": "ming", "大": "da", "鹏": "peng",
    "深": "shen", "圳": "zhen", "广": "guang", "东": "dong", "州": "zhou",
    "新": "xin", "区": "qu", "市": "shi", "省": "sheng", "县": "xian",
    "镇": "zhen", "街": "jie", "道": "dao", "村": "cun", "路": "lu",
}


def _clean_ascii(tag: Column) -> Column:
    lowered = F.lower(F.regexp_replace(tag, "[^a-zA-Z0-9_]", "_"))
    return F.regexp_replace(lowered, r"^_+|_+\z", "")


def _spell(tag: Column, readings: Column) -> Column:
    """Character by character: readings for Han characters, lower case for other
    letters and digits, ``_`` for ``_`` and ``-``, nothing for the rest."""

    def spelled(c: Column) -> Column:
        unknown = F.concat(F.lit("z"), F.lower(F.hex(F.ascii(c))))
        return (
            F.when(c.rlike("[\\u4E00-\\u9FFF]"), F.coalesce(F.element_at(readings, c), unknown))
            .when(c.rlike(r"(?U)[\p{IsAlphabetic}\d]"), F.lower(c))
            .when(c.isin("_", "-"), "_")
            .otherwise("")
        )

    joined = F.array_join(F.transform(tx.characters(tag), spelled), "")
    return F.regexp_replace(F.regexp_replace(joined, "_+", "_"), r"^_|_\z", "")


def reading_map(readings: dict[str, str] | None = None) -> Column:
    """Map column of a small reading dictionary (one literal, not a join)."""
    items = [F.lit(x) for pair in (readings or READINGS).items() for x in pair]
    return F.create_map(*items)


def tag_prefix(tag: Column, readings: Column | None = None) -> Column:
    readings = reading_map() if readings is None else readings
    stripped = tx.strip(tag)
    prefix = F.when(stripped.rlike(r"\A[\x00-\x7F]*\z"), _clean_ascii(stripped)).otherwise(_spell(stripped, readings))
    return F.coalesce(F.nullif(prefix, F.lit("")), F.lit(DEFAULT_PREFIX))


def with_tag_prefix(df: DataFrame, tag: str, readings: DataFrame, out: str = "prefix") -> DataFrame:
    """As :func:`tag_prefix` with a reading *table* (``char``, ``reading``) of any
    size: distinct tags are split into characters, joined to the table, and put
    together again, so only the (short, distinct) tags are shuffled."""
    tags = df.select(F.col(tag).alias("_tag")).distinct()
    chars = tags.select("_tag", F.posexplode(tx.characters(tx.strip(F.col("_tag")))).alias("_pos", "char"))
    known = (
        chars.join(readings.select("char", "reading"), "char")
        .groupBy("_tag")
        .agg(F.map_from_entries(F.collect_set(F.struct("char", "reading"))).alias("_readings"))
    )
    empty = F.create_map().cast("map<string,string>")
    spelled = tags.join(known, "_tag", "left").select(
        "_tag", tag_prefix(F.col("_tag"), F.coalesce("_readings", empty)).alias(out)
    )
    return df.join(spelled, df[tag].eqNullSafe(spelled["_tag"]), "left").drop("_tag")


def read_tag(tag: str, readings: DataFrame) -> str:
    """The prefix of one tag by a reading table of any size: only the readings of its characters are read."""
    rows = readings.sparkSession.createDataFrame([(tag,)], "tag string")
    return with_tag_prefix(rows, "tag", readings).first()["prefix"]


def tag_tables(prefix: Column) -> dict[str, Column]:
    return {
        "recall_table": F.concat(prefix, F.lit(RECALL_SUFFIX)),
        "match_table": F.concat(prefix, F.lit(MATCH_SUFFIX)),
    }
