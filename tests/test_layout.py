import os
import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_text_package():
    own = [p for p in (ROOT / "ledgerloom").rglob("*.py") if "llm" not in p.parts]
    assert own and not [p for p in own if re.search(r"\bllm\b", p.read_text(encoding="utf-8"))]


def test_tasks_need_no_copy_of_the_package(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import functions as F
from ledgerloom.session import local_session
from ledgerloom.operators.known_time import known_at
from ledgerloom.operators.evaluation import bootstrap_gain
spark = local_session(1, 1, "1g")
one = spark.range(5).select(F.col("id").cast("string").alias("e"), F.lit("p").alias("p"), F.current_timestamp().alias("t"))
two = spark.range(5).select(F.col("id").cast("string").alias("o"), F.lit("p").alias("p"), F.lit(1).alias("v"), F.to_timestamp(F.lit("2020-01-01")).alias("a"))
assert known_at(one, two, "e", "p", "t", "o", "v", "a", "a").count() == 5
assert bootstrap_gain(one.withColumn("g", F.lit(1.0)), "e", "g").first()["low"] == 1.0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180).returncode == 0
