"""The driver's entry points, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["id", "name", "source", "is_mine", "rating", "cook_count", "last_cooked", "is_queued"]
    assert df.count() > 0


def test_oracles_belong_to_queries():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_library_stands_alone():
    """Without the optional folder and the pipeline the entry module still imports and names the other queries."""
    code = "import sys; sys.modules['larder.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q1_recipe_list' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_optional_folder():
    for path in (ROOT / "larder").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "larder").parts:
            assert "larder.llm" not in path.read_text(), path


def test_workers_need_not_import_the_library(tmp_path):
    """A driver that finds the library by itself alone can still run the queries with Python in their tasks."""
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in ("n6_read_recipe_pages", "w7_slugs", "c12_annotation_index"):
    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
