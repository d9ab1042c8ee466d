"""Native tagger: addresses cut at their level words, one token per piece."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions import text as tx

# fixed values: level words, tested in this order, and the tag they end
LEVEL_WORDS = (
    ("devzone", "开发区|高新区|工业园|产业园|科技园"),
    ("community", "社区|居委会|村委会"),
    ("village_group", "村|组"),
    ("town", "街道|镇|乡"),
    ("prov", "省|自治区"),
    ("city", "市"),
    ("district", "新区|区|县|旗"),
    ("cellno", "单元"),
    ("subpoi", "号楼|栋|幢|座"),
    ("poi", "花园|花苑|家园|小区|公寓|大厦|中心|商城|广场|市场|商场"),
    ("floorno", "层|楼|[0-9]+F"),
    ("houseno", "室|房"),
    ("road", "大道|大街|路|街|巷|道|胡同"),
    ("roadno", "号"),
)
_ENDINGS = "|".join(words for _, words in LEVEL_WORDS)
# the words are tried only where one of their first characters stands; what lies outside the range of these
# is skipped in runs, as a set of many characters costs many times a range
_FIRSTS = "".join(sorted({w[0] for w in _ENDINGS.split("|")} - {"["}))
_OTHERS = f"[^0-9{_FIRSTS[0]}-{_FIRSTS[-1]}]*+"
_PIECE = f"(.{_OTHERS}(?:(?!(?=[0-9{_FIRSTS}])(?:{_ENDINGS})).{_OTHERS})*+(?:{_ENDINGS}|\\z))"
# a character before the longest level word, or before a digit and F
_LONGEST = 1 + max(len(w) for w in _ENDINGS.split("|") if "[" not in w)


class LevelWordTagger:
    """A piece runs up to and including the next level word and takes its tag;
    what follows the last one is a room when it is a number, else outside."""

    def __init__(self, text: str = "address"):
        self.text = text

    def _tag(self, end: Column, piece: Column) -> Column:
        tag = None
        for name, words in LEVEL_WORDS:
            test = end.rlike(f".(?:{words})\\z")
            tag = F.when(test, name) if tag is None else tag.when(test, name)
        return tag.when(piece.rlike(r"\A[a-zA-Z]?-?[0-9]{2,4}\z"), "houseno")

    def transform(self, df: DataFrame) -> DataFrame:
        address = tx.strip(tx.as_text(F.col(self.text)))
        df = df.withColumn("tokens", F.regexp_extract_all(address, F.lit("(?s)" + _PIECE), 1))

        # the end of a long piece is looked for once
        ends = F.transform("tokens", lambda p: F.struct(F.right(p, F.lit(_LONGEST)).alias("end"), p.alias("piece")))

        def label(piece: Column) -> Column:
            return F.concat(F.lit("S-"), self._tag(piece["end"], piece["piece"]))

        return df.withColumn("labels", F.transform(ends, lambda p: F.coalesce(label(p), F.lit("O"))))
