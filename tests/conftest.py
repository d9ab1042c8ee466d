from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def gazetteer(spark):
    rows = [
        (0, "福田区", ["深南大道", "滨河大道", "福华路", "益田路", "金田路"], ["福田街道", "沙头街道"], ["皇岗社区", "水围社区"], ["平安金融中心", "市民中心"]),
        (1, "南山区", ["科技南路", "科苑路", "后海大道", "创业路"], ["粤海街道", "南头街道"], ["后海社区", "大冲社区"], ["创维大厦", "腾讯大厦"]),
        (2, "宝安区", ["宝安大道", "兴华路", "新安路", "沙井路", "固戍路"], ["新安街道", "西乡街道"], ["福永社区", "沙井社区"], ["宝安图书馆", "前海中心"]),
        (3, "龙岗区", ["龙翔大道", "黄阁路", "布吉路"], ["龙城街道"], ["坂田社区", "布吉社区"], ["天安云谷", "大运软件小镇"]),
    ]
    return spark.createDataFrame(
        rows,
        "district_no int, district string, roads array<string>, streets array<string>, communities array<string>, buildings array<string>",
    )
