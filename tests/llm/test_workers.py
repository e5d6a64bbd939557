"""Every registered operator on workers that cannot import the package: a run of its own, whose driver alone has it."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The driver finds the package through sys.path; its workers start elsewhere, without it.
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {shared!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")

def importable(_):
    import importlib.util
    yield importlib.util.find_spec("aerotow") is not None
assert spark.sparkContext.parallelize([1], 1).mapPartitions(importable).collect() == [False]
from aerotow.llm.queries import QUERIES
for name in {names!r}:
    assert QUERIES[name](spark, {data!r}).count() > 0, name
    print("RAN", name, flush=True)
"""


@pytest.mark.parametrize("names", [
    ["op1_decontamination", "op2_license_scan", "op4_ngram_jaccard_join", "op6_lm_scoring"],
    ["op7_toxicity", "op8_warc", "op9_bpe", "op10_language_id"],
    ["op11_merkle_manifest", "op12_spelling_variants", "op13_quality_classifier"]])
def test_workers_without_the_package(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = RUN.format(root=ROOT, shared=f"file://{tmp_path}/shared", names=names, data="/root/testdata/sf0.001")
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [x.split()[1] for x in got.stdout.splitlines() if x.startswith("RAN")] == names, got.stderr[-2000:]
