import random
import subprocess
import sys
from pathlib import Path

import pytest

from docops.llm.shared import components


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(500, 500)]
    r.shuffle(edges)
    root = {v: v for e in edges for v in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {x.id: x.component for x in components(df).collect()}
    assert got == {v: c for v, c in root.items() if any(v in e and e[0] != e[1] for e in edges)}
    assert components(df.limit(0)).collect() == []


def test_size_of_tables_that_are_no_files(spark, tmp_path):
    """Rows without files are measured; the sides of joins are added, not multiplied."""
    from docops.llm.chunks import estimated, owners
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, "some words of text " * 20) for i in range(200)], "doc_id long, text string")
    assert estimated(rows) == 200 * 380 and owners(rows) == owners(rows.limit(0)) == 16
    rows.write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    other = files.select("doc_id", F.lit(1).alias("n"))
    joined = files.join(other, "doc_id").join(other.withColumnRenamed("n", "m"), "doc_id")
    assert owners(files) == owners(joined) == 16 and estimated(joined) < 10 * estimated(files) + 100_000
    assert owners(rows.join(other, "doc_id")) == 16


WORKER = """
import re
import pyarrow as pa
from docops.llm import chunks, ngram_join

held = lambda: int(re.search(r"Private_Dirty:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
text = " ".join(f"w{i}" for i in range(300_000)).encode()[: 2 << 20]
chunk = pa.table({"chunk": [1], "blob": pa.array([chunks.Texts.packed(pa.table({"doc_id": [1], "text": pa.array([text], pa.binary())}))])})
before = held()
for _, texts in chunks.blobs(chunk):
    ngram_join._Sets(texts, 5, 44)
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_a_worker_keeps_no_freed_arrays_of_a_chunk():
    run = subprocess.run([sys.executable, "-c", WORKER], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert float(run.stdout) < 16, run.stdout
