import re
from pathlib import Path

from gridloom.operators.layout import cut, spread_small
from gridloom.operators.sampling import global_positions

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_llm_subpackage():
    for path in (ROOT / "gridloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|from .*\bllm\b", path.read_text(encoding="utf-8")), path


def test_cut_and_spread(spark):
    df = spark.range(100).coalesce(1)
    assert spread_small(df).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(50)
    assert spread_small(wide).rdd.getNumPartitions() == 50
    assert cut(df).count() == 100


def test_positions(spark):
    rows = global_positions(spark.range(1000).selectExpr("id * 7 % 1000 as id"), "id").collect()
    assert all(r.id == r.position for r in rows) and len(rows) == 1000
