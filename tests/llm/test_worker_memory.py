"""What a Python worker keeps between the tasks of the pipeline: it lives on, and so does what it doesn't give back."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
#: MB of anonymous memory; imports, the tokenizer and its memos take 140.
MOST = 165

STAGES = r"""
import os, sys, time
sys.path.insert(0, os.environ["ROOT"])
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from snapforge.llm import packing, simhash, substring_dedup, toxicity
from snapforge.llm.queries import WORD_BPE
from snapforge.session import build_session

spark = build_session("local[1]", shuffle_partitions=1)
words = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda i: F.substring(F.md5(F.concat_ws(" ", "doc_id", i)), 1, 8))
docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text")).cache()
labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))

def kept(batches):
    for _ in batches:
        pass
    time.sleep(1)
    lines = open("/proc/self/smaps_rollup").read().splitlines()
    yield pa.RecordBatch.from_pydict({"mb": [sum(int(x.split()[1]) for x in lines if x.startswith("Private_Dirty")) // 1024]})

for out in (
    toxicity.drop_toxic(docs, labels, 100), simhash.fingerprints(docs), substring_dedup.drop_repeated_passages(docs, 35),
    packing.tokenized_pieces(docs, public_tokenizers.path(WORD_BPE)),
):
    out.write.format("noop").mode("overwrite").save()
print("MB", [r.mb for r in spark.range(1).coalesce(1).mapInArrow(kept, "mb long").collect()][0])
"""


def test_a_worker_gives_back_what_the_stages_took():
    """2500 documents of 750,000 distinct words, 6.7 MB, through one worker."""
    env = os.environ | {"ROOT": str(ROOT), "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "SNAPFORGE_DRIVER_MEMORY": "1g"}
    run = subprocess.run([sys.executable, "-c", STAGES], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    print(run.stdout)
    assert int(run.stdout.rsplit("MB", 1)[1]) < MOST
