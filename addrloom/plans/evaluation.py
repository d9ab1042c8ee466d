"""Labelled evaluation addresses, generated from a gazetteer table, and checks.

A gazetteer has one row per district: ``district_no`` (0, 1, ..), ``district``,
and the arrays ``roads``, ``streets``, ``communities``, ``buildings``.
"""

from __future__ import annotations

from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.models.pair_scorer import fit_pair_scorer
from addrloom.operators import checks, stats
from addrloom.operators.numbering import first_by_number
from addrloom.sources.tables import written

# fixed values: ways to write one address twice, (query form, reference form).
# {P} province {p} the same without its last character, {C} city {c} likewise,
# {D} district, {R} road, {N} number, {S} street, {M} community, {B} building,
# {b} short building name.
SAME_PLACE_FORMS = (
    ("{P}{C}{D}{R}{N}号", "{P}{C}{D}{R}{N}号"),
    ("{p}{C}{D}{R}{N}号", "{P}{C}{D}{R}{N}号"),
    ("{C}{D}{R}{N}号", "{P}{C}{D}{R}{N}号"),
    ("{p}{c}{D}{R}{N}号", "{P}{C}{D}{R}{N}号"),
    ("{D}{R}{N}号", "{P}{C}{D}{R}{N}号"),
    ("{C}{D}{R}{N}号", "{P}{C}{D}{S}{R}{N}号"),
    ("{C}{D}{R}{N}号", "{P}{C}{D}{S}{M}{R}{N}号"),
    ("{P}{C}{D}{R}{N}号A栋6楼601室", "{P}{C}{D}{R}{N}号A幢6层601房"),
    ("{P}{C}{D}{R}{N}号B座12层1203", "{P}{C}{D}{R}{N}号B栋12楼1203室"),
    ("{P}{C}{D}{R}{N}号3号楼15层", "{P}{C}{D}{R}{N}号3幢15楼"),
    ("{P}{C}{D}{R}{N}号8F", "{P}{C}{D}{R}{N}号8楼"),
    ("{P}{C}{D}{R}{N}号22/F", "{P}{C}{D}{R}{N}号22层"),
    ("{P}{C}{D}{R}{N}号B1", "{P}{C}{D}{R}{N}号负1层"),
    ("{P}{C}{D}{R}{N}号A-601", "{P}{C}{D}{R}{N}号A栋601室"),
    ("{P}{C}{D}{R}{N}号1203房", "{P}{C}{D}{R}{N}号1203室"),
    ("{P}{C}{D}{R}{N}号3-1502", "{P}{C}{D}{R}{N}号3栋1502室"),
    ("{P}{C}{D}{R}{N}-1号", "{P}{C}{D}{R}{N}号附1号"),
    ("{C}{D}{R}{N}号（{B}）", "{P}{C}{D}{R}{N}号{B}"),
    ("{C}{D}{R}{N}号{b}", "{P}{C}{D}{R}{N}号{B}"),
    ("{C}{D}{M}{R}{N}号", "{P}{C}{D}{R}{N}号"),
)
# fixed values: what the two forms of a type differ in, as stored; {S} {M} {B} {b} {N} as above
DIFFERENCES = (
    "地址文本完全相同",
    "企业地址省略'省'字",
    "企业地址省略省份",
    "企业地址省略'省'和'市'字",
    "企业地址省略省份和'市'",
    "标准地址补充了'{S}'",
    "标准地址补充了'{S}{M}'",
    "'栋'与'幢'、'楼'与'层'、'室'与'房'同义替换",
    "'座'与'栋'、'层'与'楼'同义，企业地址省略'室'",
    "'号楼'与'幢'、'层'与'楼'同义替换",
    "'8F'与'8楼'为同一楼层的不同表达",
    "'22/F'与'22层'为同一楼层的不同表达",
    "'B1'与'负1层'为同一地下楼层的不同表达",
    "'A-601'与'A栋601室'为同一房间的不同表达",
    "'房'与'室'同义替换",
    "'3-1502'与'3栋1502室'为同一房间的不同表达",
    "'{N}-1号'与'{N}号附1号'为同一地址的不同格式",
    "企业地址用括号标注'{B}'，标准地址无括号",
    "'{b}'与'{B}'为同一建筑的不同简称",
    "企业地址多了社区名'{M}'，标准地址省略",
)
# fixed values: forms of reference addresses that match no query.  {i5} {i20}
# {i8} {i30} {i3} count from 1 to that number, {o} is one of 一二三四五.
DISTRACTOR_FORMS = (
    "{P}{C}{D}{S}{R}{N}号",
    "{P}{C}{D}{R}{N}号{B}",
    "{P}{C}{D}{R}{N}号{i5}栋{i20}楼{i8}01室",
    "{P}{C}{D}{R}{N}号A座{i30}层",
    "{P}{C}{D}{R}{N}号附{i3}号",
    "{P}{C}{D}{R}{N}号之{o}",
)
# pairs that agree in part: other number, other building letter, building on one
# side only, other stretch of the road
PART_FORMS = (
    ("{C}{D}{R}{N}号", "{P}{C}{D}{R}{N2}号"),
    ("{C}{D}{R}{N}号A栋", "{P}{C}{D}{R}{N}号B栋"),
    ("{C}{D}{R}{N}号", "{P}{C}{D}{R}{N}号{B}"),
    ("{C}{D}{R}东段{N}号", "{P}{C}{D}{R}西段{N2}号"),
)
# fixed values: stored words of the evaluation tables
EXPECTED = {"exact": "完全匹配", "partial": "部分匹配", "none": "不匹配"}
SAME_TEXT, OTHER_TEXT, OTHER_MEANING = "完全一致", "部分一致", "语义差别"
# shift of each picked name, so that one address does not use the same place of every list
PICK_SHIFT = {"S": {5: 0, 6: 1}, "M": {6: 2, 19: 5}, "B": {17: 3, 18: 4}}


def _pick(names: Column, at: Column) -> Column:
    return F.element_at(names, (F.pmod(at, F.size(names)) + 1).cast("int"))


def _without_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.char_length(text) - 1)


def render(form: str, parts: dict[str, Column]) -> Column:
    """A form with its places filled in."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(form):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(parts[name])
    return F.concat(*pieces)


def _by_type(kind: Column, options: list[Column]) -> Column:
    choice = F.when(kind == 0, options[0])
    for i, option in enumerate(options[1:], start=1):
        choice = choice.when(kind == i, option)
    return choice


def _parts(province: Column, city: Column, number: Column) -> dict[str, Column]:
    return {
        "P": province, "p": _without_last(province), "C": city, "c": _without_last(city),
        "D": F.col("district"), "R": F.col("road"), "N": number.cast("string"),
    }


def write_variants(df: DataFrame, kind: Column, province: str = "广东省", city: str = "深圳市") -> DataFrame:
    """Two spellings of the address in every row: ``enterprise_address``,
    ``standard_address`` and ``semantic_diff`` by type 0-19.  ``df`` has
    ``district, road, number, streets, communities, buildings``.  Names are picked
    by the house number, so a row always gets the same text."""
    parts = _parts(F.lit(province), F.lit(city), F.col("number"))

    def filled(i: int, form: str) -> Column:
        shift = lambda name: PICK_SHIFT[name].get(i, 0)
        building = _pick(F.col("buildings"), F.col("number") + shift("B"))
        return render(
            form,
            parts | {
                "S": _pick(F.col("streets"), F.col("number") + shift("S")),
                "M": _pick(F.col("communities"), F.col("number") + shift("M")),
                "B": building,
                "b": F.when(F.char_length(building) > 4, F.substring(building, 1, 2)).otherwise(building),
            },
        )

    return df.withColumn("transform_type", kind.cast("int")).withColumns(
        {
            "enterprise_address": _by_type(
                F.col("transform_type"), [filled(i, f[0]) for i, f in enumerate(SAME_PLACE_FORMS)]
            ),
            "standard_address": _by_type(
                F.col("transform_type"), [filled(i, f[1]) for i, f in enumerate(SAME_PLACE_FORMS)]
            ),
            "semantic_diff": _by_type(F.col("transform_type"), [filled(i, d) for i, d in enumerate(DIFFERENCES)]),
        }
    )


def consistency_type(a: Column, b: Column) -> Column:
    return F.when(a != b, OTHER_TEXT).otherwise(SAME_TEXT)


def evaluation_rows(variants: DataFrame, group_id: Column) -> DataFrame:
    """Variants with ids, names and expected class in the evaluation layout."""
    group = group_id.cast("long")
    return variants.select(
        group.alias("group_id"),
        F.format_string("EVAL_E%04d", group).alias("enterprise_id"),
        F.format_string("深圳测评企业%04d", group).alias("enterprise_name"),
        "enterprise_address",
        F.format_string("EVAL_A%04d", group).alias("standard_addr_code"),
        "standard_address",
        F.format_string("HC%08d", group).alias("house_code"),
        consistency_type(F.col("enterprise_address"), F.col("standard_address")).alias("consistency_type"),
        F.lit(EXPECTED["exact"]).alias("expected_match"),
        "semantic_diff",
        "transform_type",
    )


def _road_slots(gazetteer: DataFrame) -> DataFrame:
    """One row per road with its ``slot``, its place in the whole list: the roads of earlier
    districts, from a running sum over one number per district, and the place in its own."""
    before = Window.orderBy("district_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = gazetteer.select("district_no", F.size("roads").alias("n")).select(
        "district_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    roads = gazetteer.join(starts, "district_no").select("*", F.posexplode("roads").alias("road_no", "road"))
    return roads.withColumn("slot", F.col("start") + F.col("road_no")).drop("roads", "road_no", "start")


def _numbered(gazetteer: DataFrame, count: int, shift: int = 0) -> DataFrame:
    """``count`` rows k = 0.. that go round the roads in order."""
    slots = _road_slots(gazetteer)
    size = slots.count()
    numbers = gazetteer.sparkSession.range(count).withColumn("slot", F.pmod(F.col("id") + shift, F.lit(size)))
    return numbers.join(slots, "slot").drop("slot")


def match_pairs(gazetteer: DataFrame, count: int = 1000, **place: str) -> DataFrame:
    """``count`` differently written pairs of equal places; pair k has number
    37 (k + 1) + 100 and type k mod 20."""
    rows = _numbered(gazetteer, count).withColumn("number", (F.col("id") + 1) * 37 + 100)
    return evaluation_rows(write_variants(rows, F.pmod("id", F.lit(len(SAME_PLACE_FORMS))), **place), F.col("id") + 1)


def write_distractors(df: DataFrame, at: Column, province: str = "广东省", city: str = "深圳市") -> DataFrame:
    """``standard_address`` of every row by the six forms, chosen by ``at``.
    ``df`` has ``district, road, number, streets, buildings``."""
    count_to = lambda n: (F.pmod(at, F.lit(n)) + 1).cast("string")
    parts = _parts(F.lit(province), F.lit(city), F.col("number")) | {
        "S": _pick(F.col("streets"), at), "B": _pick(F.col("buildings"), at),
        "o": _pick(F.array(*[F.lit(c) for c in "一二三四五"]), at),
        **{f"i{n}": count_to(n) for n in (3, 5, 8, 20, 30)},
    }
    kind = F.pmod(at, F.lit(len(DISTRACTOR_FORMS)))
    return df.withColumn("standard_address", _by_type(kind, [render(f, parts) for f in DISTRACTOR_FORMS]))


def distractor_rows(df: DataFrame, at: Column, used: DataFrame) -> DataFrame:
    """Distractors in the evaluation layout, without the addresses of the pairs
    ``used`` (enterprise_address, standard_address)."""
    taken = used.select(F.col("enterprise_address").alias("standard_address")).union(used.select("standard_address"))
    made = df.select(
        F.format_string("EVAL_D%04d", at + 1).alias("addr_code"),
        "standard_address",
        F.format_string("HD%08d", at + 1).alias("house_code"),
    )
    return checks.unused(made, taken, "standard_address")


def distractors(gazetteer: DataFrame, pairs: DataFrame, count: int = 9000, **place: str) -> DataFrame:
    """``count`` reference addresses by six forms; number k has house number 7 k + 501.
    Those already used are left out and replaced by further numbers, which are tried until
    there are ``count``: no more of them are used than the pairs have addresses."""
    districts, at = gazetteer.count(), F.col("id")
    tried = count + 2 * pairs.count()
    rows = gazetteer.sparkSession.range(tried).withColumn("district_no", F.pmod("id", F.lit(districts))).join(
        gazetteer.withColumn("district_no", F.col("district_no").cast("long")), "district_no"
    )
    rows = rows.withColumn("road", _pick(F.col("roads"), at)).withColumn("number", at * 7 + 501)
    made = written(distractor_rows(write_distractors(rows, at, **place), at, pairs), "distractors")
    # the house code holds the number, which gives the order they were tried in
    return first_by_number(made, F.expr("cast(substring(house_code, 3) as long) - 1"), count)


def labelled_pairs(gazetteer: DataFrame, count: int = 1000, province: str = "广东省", city: str = "深圳市") -> DataFrame:
    """Pairs of all three classes (``class_index`` 0 none, 1 partial, 2 exact), the
    same number of each: equal places, places that agree in part, and addresses
    of different districts."""
    exact = match_pairs(gazetteer, count, province=province, city=city).select(
        F.col("enterprise_address").alias("address_a"), F.col("standard_address").alias("address_b"),
        F.lit(2).alias("class_index"), F.lit(EXPECTED["exact"]).alias("expected_match"),
    )
    rows = _numbered(gazetteer, count).withColumn("number", (F.col("id") + 1) * 41 + 60)
    parts = _parts(F.lit(province), F.lit(city), F.col("number")) | {
        "N2": (F.col("number") + 2 + F.pmod("id", F.lit(90))).cast("string"),
        "B": _pick(F.col("buildings"), F.col("id")),
    }
    kind = F.pmod("id", F.lit(len(PART_FORMS)))
    partial = rows.select(
        _by_type(kind, [render(a, parts) for a, _ in PART_FORMS]).alias("address_a"),
        _by_type(kind, [render(b, parts) for _, b in PART_FORMS]).alias("address_b"),
        F.lit(1).alias("class_index"), F.lit(EXPECTED["partial"]).alias("expected_match"),
    )
    # the other side: a road half the list away, that is, of another district
    half = _road_slots(gazetteer).count() // 2
    far = _numbered(gazetteer, count, half).select("id", F.col("district").alias("district2"), F.col("road").alias("road2"))
    none = rows.join(far, "id").where("district <> district2").select(
        render("{C}{D}{R}{N}号", parts).alias("address_a"),
        F.concat(F.lit(province), F.lit(city), "district2", "road2", (F.col("number") * 3 + 7).cast("string"), F.lit("号")).alias("address_b"),
        F.lit(0).alias("class_index"), F.lit(EXPECTED["none"]).alias("expected_match"),
    )
    return checks.all_addresses(exact, partial, none)


def fit_on(gazetteer: DataFrame, count: int = 1000):
    """The native pair scorer with weights fitted on generated pairs."""
    return fit_pair_scorer(labelled_pairs(gazetteer, count))


def accuracy(scored: DataFrame, status: str = "match_status", expected: str = "expected_match") -> DataFrame:
    """Per expected class: rows, rows judged so, share in percent."""
    word = {"完全匹配": "精确匹配", "部分匹配": "部分匹配", "不匹配": "不匹配"}
    wanted = reduce(
        lambda c, kv: c.when(F.col(expected) == kv[0], kv[1]), list(word.items())[1:],
        F.when(F.col(expected) == "完全匹配", "精确匹配"),
    )
    return scored.groupBy(expected).agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col(status) == wanted).alias("right_count"),
    ).withColumn("right_rate", F.col("right_count") / F.col("row_count") * 100)


def verify(queries: DataFrame, references: DataFrame) -> DataFrame:
    """Row counts by id prefix and duplicate addresses of loaded evaluation rows;
    both tables have ``source_id, address``.  One row, one pass per table."""

    def counts(df: DataFrame, patterns: dict[str, str], within: str, duplicates: str) -> DataFrame:
        like = lambda p: F.col("source_id").like(p)
        mine = F.when(like(within), F.col("address"))
        return df.agg(
            *[F.count_if(like(p)).alias(name) for name, p in patterns.items()],
            (F.count(mine) - F.countDistinct(mine)).alias(duplicates),
        )

    return stats.side_by_side(
        counts(queries, {"e_count": "EVAL_E%"}, "EVAL_E%", "e_dup"),
        counts(references, {"a_count": "EVAL_A%", "d_count": "EVAL_D%", "s_total": "EVAL_%"}, "EVAL_%", "s_dup"),
    )
