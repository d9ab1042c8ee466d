"""Fixed values shared by the whole package.

Every literal here is part of the data format (column names, stored status
words, label names, suffix lists, numeric defaults), so that tables written by
other tools of the same format can be read and compared.
"""

# -- fixed values: stored words ---------------------------------------------
EXACT = "精确匹配"
PARTIAL = "部分匹配"
NOT_MATCHED = "不匹配"
STATUSES = (EXACT, PARTIAL, NOT_MATCHED)

SOURCE_AUTO = "自动匹配"
SOURCE_PICKED = "人工纠正"
SOURCE_EDITED = "人工匹配"
# label shown to people -> stored word
SOURCE_LABELS = {"人工选择": SOURCE_PICKED}

# class index of the three-class pair model -> score column
CLASS_NAMES = ("not_match", "partial_match", "exact_match")
SCORE_COLUMNS = ("exact_match", "partial_match", "not_match")

# -- fixed values: address levels -------------------------------------------
FIELDS_12 = (
    "province", "city", "district", "street", "community", "road",
    "roadno", "area", "bldg", "unit", "floor", "house",
)
FIELDS_17 = (
    "prov", "city", "district", "town", "road", "roadno", "intersection",
    "poi", "subpoi", "houseno", "cellno", "floorno", "community",
    "assist", "distance", "devzone", "village_group",
)
FIELDS_34 = tuple(name for f in FIELDS_17 for name in (f, f + "_2"))

# output field of the 12-level form -> entity tags that feed it
TAGS_OF_FIELD_12 = {
    "province": ("prov",),
    "city": ("city",),
    "district": ("district",),
    "street": ("town",),
    "community": ("community",),
    "road": ("road",),
    "roadno": ("roadno",),
    "area": ("poi", "devzone", "village_group"),
    "bldg": ("subpoi",),
    "unit": ("cellno",),
    "floor": ("floorno",),
    "house": ("houseno",),
}

# -- fixed values: suffix lists of the entity rules ---------------------------
BUILDING_SUFFIXES = ("栋", "幢", "座", "号楼", "栋楼", "号楼栋")
ROOM_SUFFIXES = ("室", "房", "号房")
AREA_SUFFIXES = (
    "花园", "花苑", "家园", "小区", "公寓", "大厦", "中心", "商城", "广场",
    "市场", "商场", "鑫苑", "名苑", "绿洲", "雅苑", "华庭", "豪庭", "名庭",
    "嘉园", "华府",
)

# tokens a tokenizer adds around the text
SPECIAL_TOKENS = ("[CLS]", "[SEP]", "<s>", "</s>")

# -- fixed values: defaults ---------------------------------------------------
VECTOR_DIM = 768
TOP_N = 10
RANK_THRESHOLD = 0.8
NORM_TOLERANCE = 0.1
SAME_ADDRESS_SIMILARITY = 0.99
EXPORT_ROWS = 5000
CSV_ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb2312", "gb18030", "latin1")

RECALL_SUFFIX = "_recall_results"
MATCH_SUFFIX = "_match_results"
DEFAULT_PREFIX = "default"
