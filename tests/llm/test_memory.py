"""What Python workers hold: few texts at a time, and little of the tasks before."""

import subprocess
import sys
from pathlib import Path

from pagewright.llm import decontamination, neardup, substrings

ROOT = Path(__file__).resolve().parents[2]

TASK = """
import re
import numpy as np, pyarrow as pa
from pagewright.llm import quality

class Docs:
    schema = "doc_id long, text string"
    sparkContext = type("", (), {"broadcast": staticmethod(lambda x: type("", (), {"value": x}))})
    sparkSession = property(lambda self: self)

    def mapInArrow(self, f, schema):
        return f

def held():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    for k in range(2):
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4000)), "text": [" ".join(f"w{(i * 400 + j) % 99991}x{k}" for j in range(400)) for i in range(4000)]})

task = quality.accepted(Docs(), np.zeros(1 << 18, np.float32), 0.0)
before = held()
assert sum(b.num_rows for b in task(batches())) == 8000
print(held() - before)
"""


def test_tasks_give_their_memory_back():
    run = subprocess.run([sys.executable, "-c", TASK], cwd=ROOT, capture_output=True, text=True, check=True)
    assert float(run.stdout) < 40


def test_few_texts_at_a_time(spark, monkeypatch, tmp_path):
    seen = tmp_path / "rows"

    def spied(module):
        of = module.map_arrow

        def map_arrow(df, f, schema):
            def start(f=f, path=str(seen), reads="text" in df.columns):
                run = f()

                def told(batch):
                    if reads:
                        with open(path, "a") as out:
                            out.write(f"{batch.num_rows}\n")
                    return run(batch)

                return told

            return of(df, start, schema)

        monkeypatch.setattr(module, "map_arrow", map_arrow)

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(2500).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 40), i -> concat('w', i + 50 * (id % 2000)))) as text").coalesce(1)
    items = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id long, text string")
    for module, run in ((substrings, substrings.deduplicated), (neardup, neardup.without_near_copies), (decontamination, lambda d: decontamination.decontaminated(d, items))):
        spied(module)
        seen.write_text("")
        run(docs).count()
        rows = list(map(int, seen.read_text().split()))
        assert sum(rows) >= 2500
        assert max(rows) <= 1000
    assert spark.conf.get(key) == before
