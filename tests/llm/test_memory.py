"""What the pipeline's stages hold in a worker and send to the JVM at once."""

import os
import subprocess
import sys

import pyarrow as pa
from pyspark.sql import functions as F

from actloom.llm import mixing
from actloom.llm.batches import Rows, in_slices
from actloom.llm.quality_classifier import merged

#: The steps over one batch of 8 MB; prints by how many MB the greatest resident size grows.
STEPS = """
import resource
import numpy as np, pyarrow as pa, pyarrow.acero, pyarrow.compute
from actloom.llm import quality_classifier as q
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
rng = np.random.default_rng(1)
text = np.frombuffer(b"etaoin s", np.uint8)[rng.integers(0, 8, 8 << 20, np.uint8)]
ends = np.arange(1, 2049) * 4096
meta = pa.table({"id": pa.array(range(2048), pa.int64()), "fp": pa.array(range(2048), pa.int64()), "lang": ["en"] * 2048})
marks = pa.table({"row": pa.array(range(2048), pa.int64())})
before = most()
q._counts(5)(1, meta, ends, text, marks)
codes = q._wanted(5)(1, meta, ends, text).column("code")
q._score(5)(1, meta, ends, text, pa.table({"code": codes, "p": pa.array(np.full(len(codes), 0.5, np.float32))}))
print(most() - before)
"""


def test_a_classifier_step_takes_few_times_its_batch():
    """Measured: 18 MB more than before the steps, and 52 MB when a batch was worked on by the megabyte."""
    grown = float(subprocess.run([sys.executable, "-c", STEPS], capture_output=True, text=True, check=True, timeout=120, env=os.environ | {"OMP_NUM_THREADS": "1"}).stdout)
    assert grown < 35


def test_merged_holds_about_twice_what_is_left():
    held = []

    def merge(parts):
        held.append(sum(map(len, parts)))
        return sorted(set().union(*parts))

    assert merged((list(range(i % 7, 100_000, 7)) for i in range(70)), merge) == list(range(100_000))
    assert max(held) <= 2 * 100_000 + (1 << 17) + 100_000 and merged(iter(()), merge) == []


def test_rows_come_back_whole_from_slices(spark):
    docs = spark.range(400).coalesce(1).select("id", F.repeat(F.lit("x" * 100), 100).alias("text"))
    rows, none = Rows(docs, "text", {}), spark.createDataFrame([], "batch_id long, row int")
    assert [r.id for r in rows.without(none).select("id").collect()] == list(range(400))
    every = rows.batches.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("row"))
    assert rows.without(every).count() == 0


def test_slices():
    whole = pa.table({"id": list(range(400)), "text": ["x" * 10_000] * 400})
    cut = in_slices(whole)
    assert cut.equals(whole) and len(cut.to_batches()) >= 4 and max(b.nbytes for b in cut.to_batches()) <= 1 << 20
    assert in_slices(whole.slice(0, 0)).num_rows == 0 and in_slices(whole, 10).num_rows == 400


def test_small_tables_of_the_mix_start_no_python_workers(spark):
    """A list of rows becomes a scan of an RDD that Python workers of another kind write."""
    made = mixing._small(spark, [(1, None, 2.5), (2, "b", 0.5)], "number int, source string, target double")
    assert "LocalTableScan" in made._jdf.queryExecution().executedPlan().toString()
    assert made.dtypes == [("number", "int"), ("source", "string"), ("target", "double")]
    assert sorted(map(tuple, made.collect())) == [(1, None, 2.5), (2, "b", 0.5)]
    assert mixing._small(spark, [], "number int, source string").collect() == []
