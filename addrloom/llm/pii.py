"""Personal data and the terms that give it away.

Addresses, numbers and the like are found by patterns.  Then the corpus itself says which words of the same texts are as good
as the value.  With ``both`` different texts that hold the term and the value, of ``texts`` that hold the term, the value's
posterior is both / texts; its lower confidence limit ``p`` is what a reader learns at least, and

    IC(value)   = log(N / n(value))       N documents, n(value) texts with the value
    share       = 1 + log(p) / IC(value)  the part of the value's information that the term carries

A term discloses a value if the share reaches a threshold and at most one bit is left (p is a half or more).  Near copies of one text
prove nothing: the sample behind the limit is the number of texts that differ in every one of eight min-hashes.  Such terms are
replaced by their class wherever they stand, in every document that holds them, and removed above a second threshold.
Everything is column expressions; of the others than documents with personal data only counts of the terms in question and the
keys of documents with a disclosing term leave their partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions.once import computed_once
from addrloom.llm.keys import marked, with_bit, within
from addrloom.llm.shared import stored

# Runs may begin only where a run begins, or where the last match ended: this finds the same leftmost
# matches as the plain patterns, in time linear in the text.
_EMAIL_START = r"(?:(?<![A-Za-z0-9._%+-])|\G)"
PATTERNS = {
    "email": _EMAIL_START + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# no match of a kind without this
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
TERM = "term"

TERM_PATTERN = r"[\p{L}\p{N}]{3,}"
MIN_TEXTS, DISCLOSES, REMOVES = 3, 0.8, 0.95
# of a one-sided confidence of 95 %, and the least posterior of a disclosed value: one bit is left
Z, POSTERIOR = 1.645, 0.5
MIN_HASHES = 8
# spans of a text that are worked on together, so that many spans do not cost their square
BLOCK = 128

SPAN = "struct<start: int, end: int, value: string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: (
        F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d >= "5", d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    ))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?(?:\.|$)){4}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.char_length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where lambdas mention it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _in_blocks(items: Column, body) -> Column:
    """``body`` of the items in arrays of at most ``BLOCK``; of one empty array if there are none."""
    def cut(whole: Column) -> Column:
        last = F.greatest(F.size(whole) - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda b: F.slice(whole, b * BLOCK + 1, BLOCK))

    return _let(_let(items, cut), body)


def _running(numbers: Column, join) -> Column:
    """Before each number, and after the last, what ``join`` has made of 0 and those before it."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(join(F.element_at(a, -1), x))))


def _matches(text: Column, pattern: Column) -> Column:
    """All matches, in order: (start, end, value)."""
    found = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    sized = F.transform(F.filter(found, lambda x: x["value"].isNotNull()), lambda x: F.struct(
        F.char_length(x["before"]).alias("before"), F.char_length(x["value"]).alias("long"), x["value"].alias("value")
    ))
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["before"]
        end = begin + x["long"]
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(
            F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        )).alias("spans"))

    def placed(blocks: Column) -> Column:
        length = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["before"] + x["long"]))
        return F.transform(F.arrays_zip(blocks.alias("block"), _running(length, lambda a, x: a + x).alias("at")), lambda z: F.aggregate(
            F.coalesce(z["block"], F.expr("cast(array() as array<struct<before: int, long: int, value: string>>)")),
            F.struct(z["at"].alias("at"), none.alias("spans")), step, lambda a: a["spans"],
        ))

    return F.flatten(_in_blocks(sized, placed))


def _base(text: Column, kind: str) -> Column:
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    found = F.filter(_matches(text, F.lit(PATTERNS[kind])), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(_HINT[kind]), found).otherwise(none)


def _texts(documents: DataFrame, text_column: str, carry: tuple[str, ...]) -> DataFrame:
    """``document`` (a struct of the carried columns), ``text`` and ``missing``."""
    return documents.select(
        F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("document"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
        F.col(f"`{text_column}`").isNull().alias("missing"),
    )


def base_spans(documents: DataFrame, text_column: str, carry: tuple[str, ...]) -> DataFrame:
    """``document`` (a struct of the carried columns), ``text`` and one array of spans per kind."""
    rows = _texts(documents, text_column, carry)
    rows = rows.withColumns({k: _base(F.col("text"), k) for k in KINDS})
    return computed_once(rows, *KINDS)


def _has_base() -> Column:
    return F.greatest(*[F.size(k) for k in KINDS]) > 0


def _replaced(text: Column, spans: Column) -> Column:
    """The text with every span (start, end, said) replaced; spans that overlap as one, by what the first becomes."""

    def ends_of(blocks: Column) -> Column:
        return _running(F.transform(blocks, lambda b: F.coalesce(F.array_max(F.transform(b, lambda s: s["end"])), F.lit(0))), F.greatest)

    def cut(blocks: Column, ends: Column) -> Column:
        # a block's spans lie in the text between what was covered before it and after it
        each = F.transform(blocks, lambda b, i: F.struct(
            b.alias("spans"), F.get(ends, i).alias("at"), F.substring(text, F.get(ends, i) + 1, F.get(ends, i + 1) - F.get(ends, i)).alias("text")
        ))
        pieces = F.transform(each, lambda e: F.aggregate(
            e["spans"], F.struct(e["at"].alias("at"), F.expr("cast(array() as array<string>)").alias("pieces")),
            lambda a, s: F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.when(s["start"] >= a["at"], F.concat(a["pieces"], F.array(
                    F.substring(e["text"], a["at"] - e["at"] + 1, s["start"] - a["at"]), s["said"]
                ))).otherwise(a["pieces"]).alias("pieces"),
            ),
            lambda a: F.array_join(a["pieces"], ""),
        ))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text)))

    return _in_blocks(F.array_sort(spans), lambda blocks: _let(ends_of(blocks), lambda ends: cut(blocks, ends)))


def _said(kind: str, said: str) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(said).alias("said")))


def _values() -> Column:
    """The different values of a text, in plain form."""
    def plain(kind: str) -> Column:
        form = F.lower if kind in ("email", "ip") else _digits
        return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), form(s["value"])))

    return F.array_distinct(F.concat(*map(plain, KINDS)))


def _spoken(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0)))


def _min_hashes(text: Column) -> Column:
    """Eight numbers that near copies of a text share for the most part, and other texts do not: of its pairs of terms."""
    terms = F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))

    def pairs(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0)))
        return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))

    def least(told: Column, k: int) -> Column:
        return F.array_min(F.transform(told, lambda w: F.md5(F.concat(F.lit(f"{k}:"), w).cast("binary"))))

    return _let(_let(terms, pairs), lambda told: F.array(*[least(told, k) for k in range(MIN_HASHES)]))


def _lower_limit(share: Column, sample: Column) -> Column:
    """The lower confidence limit (Wilson) of a share seen in a sample."""
    z2 = Z * Z
    spread = F.sqrt(F.greatest(share * (1 - share) / sample + z2 / (4 * sample * sample), F.lit(0.0)))
    return (share + z2 / (2 * sample) - Z * spread) / (1 + z2 / sample)


def counted_terms(rows: DataFrame, text: Column, wanted: DataFrame, name: str) -> DataFrame:
    """``term`` and, named ``name``, in how many different texts each wanted term stands.

    Terms that nobody wants are dropped where the texts lie, by a table of bits; what is left is summed up there.  The join
    is an inner one on purpose: a semi join would be moved below the sum, and ship every (text, term).
    """
    terms = wanted.select("term").distinct()
    said = F.struct(F.xxhash64(text), F.crc32(text.cast("binary")))
    spoken = rows.select(said.alias("said"), F.explode(_spoken(text)).alias("term")).where(marked(terms, "term"))
    return spoken.distinct().groupBy("term").agg(F.count(F.lit(1)).alias(name)).join(terms, "term")


def disclosing_terms(
    documents: DataFrame, private: DataFrame, text_column: str = "text", min_texts: int = MIN_TEXTS, discloses: float = DISCLOSES,
) -> DataFrame:
    """``value``, ``term`` and ``share``, the part of the value's information that the term carries.

    Counts are of different whole texts.  A pair is judged from ``min_texts`` texts on that are no near copies of each other.  A
    value's own letters are no term.  A term in more than twice the texts of the pair cannot disclose; those that are already too
    frequent in the ``private`` documents alone are left out before the whole corpus is counted.
    """
    texts = stored(private.select("said", "text", *KINDS).dropDuplicates(["said"]), "pii-texts")
    held = texts.select("said", F.explode(_values()).alias("value"))
    values = held.groupBy("value").agg(F.count(F.lit(1)).alias("n_value")).where(F.col("n_value") >= min_texts)
    total = documents.agg(F.count(F.lit(1)).alias("n"))  # one row
    values = stored(values.join(F.broadcast(total)).where("n > n_value"), "pii-values")
    # texts with a value that can be judged
    judged = within(held, values, "value").join(values.select("value"), "value").groupBy("said").agg(F.collect_list("value").alias("wanted"))
    outside = _replaced(F.col("text"), F.concat(*[_said(k, " ") for k in KINDS]))
    # stored before it is taken apart, or Spark would make the marks once a term
    each = stored(within(texts, judged, "said").join(judged, "said").select(
        "wanted", _min_hashes(F.col("text")).alias("marks"), F.array_intersect(_spoken(outside), _spoken(F.col("text"))).alias("terms"),
    ), "pii-judged")
    differ = [F.size(F.collect_set(F.get("marks", F.lit(k)))).cast("long") for k in range(MIN_HASHES)]
    # pre-counted: most pairs stand in too few texts for the sets to be worth making
    rows = each.select("marks", "wanted", F.explode("terms").alias("term")).select("marks", "term", F.explode("wanted").alias("value"))
    often = rows.groupBy("value", "term").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= min_texts)
    often = stored(often, "pii-often")
    pairs = within(rows, often, "value", "term").groupBy("value", "term").agg(F.least(*differ).alias("support"))
    pairs = pairs.where(F.col("support") >= min_texts).join(often, ["value", "term"]).join(values, "value")
    pairs = stored(pairs, "pii-pairs")
    rare = 2 * F.col("n_both")
    least = counted_terms(private, F.col("text"), pairs, "n_least")
    pairs = stored(pairs.join(least, "term").where(F.col("n_least") <= rare), "pii-rare-pairs")
    counts = counted_terms(documents, F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")), pairs, "n_term")
    posterior = F.col("n_both") / F.col("n_term")
    pairs = pairs.join(counts, "term").withColumn("p", _lower_limit(posterior, F.col("support") / posterior))
    share = 1 + F.log("p") / F.log(F.col("n") / F.col("n_value"))
    pairs = pairs.withColumn("share", share).where((F.col("p") >= POSTERIOR) & (F.col("share") >= discloses))
    return pairs.select("value", "term", "share")


def find(
    documents: DataFrame, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text", min_texts: int = MIN_TEXTS,
    discloses: float = DISCLOSES,
) -> DataFrame:
    """``document`` (a struct of the carried columns), ``text``, ``missing`` (it was null), one array of spans
    (start, end, value; code points) per kind of ``KINDS``, and ``term``: the disclosing terms' spans with their
    share.

    A null text is empty.  A disclosing term is found wherever it stands, also in documents without the value.
    Repeated rows are judged alike, and copies do not make a term disclosing.  Ties do not matter, as spans are
    positions.  An empty table gives no rows; carried names cannot clash with results, as they stay inside the struct.
    """
    key = F.struct(F.xxhash64("document").alias("a"), F.xxhash64("text").alias("b"), F.crc32(F.col("text").cast("binary")).alias("c"))
    rows = base_spans(documents, text_column, carry).withColumn("key", key)
    private = stored(rows.where(_has_base()).withColumn("said", F.struct(F.xxhash64("text"), F.crc32(F.col("text").cast("binary")))), "pii-private")
    told = disclosing_terms(documents, private, text_column, min_texts, discloses)
    told = stored(told.groupBy("term").agg(F.max("share").alias("share")), "pii-told")
    spoken = _texts(documents, text_column, carry).select(key.alias("key"), F.explode(_spoken(F.col("text"))).alias("term"))
    flagged = spoken.where(marked(told, "term")).join(told, "term").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("told"))
    flagged = stored(flagged, "pii-flagged")
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string, share: double>>)")
    pattern = F.concat(
        F.lit(r"(?<![\p{L}\p{N}])(?iu:"), F.array_join(F.map_keys("told"), "|"), F.lit(r")(?![\p{L}\p{N}])")
    )
    spans = F.transform(_matches(F.col("text"), pattern), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
        F.coalesce(F.col("told")[F.lower(s["value"])], F.lit(0.0)).alias("share"),
    ))
    names = ["document", "text", "missing", *KINDS, TERM]

    def located(some: DataFrame) -> DataFrame:
        return some.join(flagged, "key", "left").withColumn(TERM, F.when(F.col("told").isNull(), none).otherwise(spans)).select(*names)

    # the other texts meet the flagged keys only where a bit of their key's hash is set, so those without a term stay
    # where they lie
    others = with_bit(rows.where(~_has_base()), flagged, "met", "key")
    quiet = others.where(~F.col("met")).withColumn(TERM, none).select(*names)
    return quiet.unionByName(located(others.where("met").drop("met"))).unionByName(located(private))


def joined(*kinds: str) -> Column:
    """``kind:start:end`` of the kinds' spans, comma-joined."""
    def told(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*map(told, kinds)), ",")


def sanitise(documents: DataFrame, text_column: str = "text", removes: float = REMOVES, **options) -> DataFrame:
    """The documents, with their columns, after replacing every span: base spans by their kind in
    brackets, disclosing terms by ``[NUMBER]`` or ``[TERM]``, or by nothing if their share of the value's
    information reaches ``removes``.  Spans that overlap are replaced as one, by what the first becomes.  A
    null text stays null.
    """
    others = tuple(c for c in documents.columns if c != text_column)
    rows = find(documents, others, text_column, **options)

    term = F.transform(TERM, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.when(s["share"] >= removes, "").when(s["value"].rlike("[0-9]"), "[NUMBER]").otherwise("[TERM]").alias("said"),
    ))
    text = F.col("text")
    cut = _replaced(text, F.concat(*[_said(k, f"[{k.upper()}]") for k in KINDS], term))
    clean = F.when(F.col("missing"), F.lit(None).cast("string")).when(~_has_base() & (F.size(TERM) == 0), text).otherwise(cut)
    return rows.select(*[clean.alias(c) if c == text_column else F.col(f"document.`{c}`").alias(c) for c in documents.columns])
