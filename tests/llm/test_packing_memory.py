"""What a task that tokenises texts holds beyond its input."""

import subprocess
import sys

CHILD = """
import random
import types

import pyarrow as pa
import public_tokenizers
import pyspark

from wrenlake.llm import packing

rng = random.Random(1)
line = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(1000))
texts = [line() for _ in range(2600)]
batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
pyspark.TaskContext.get = staticmethod(lambda: types.SimpleNamespace(partitionId=lambda: 0))


class Docs:
    dtypes = [("doc_id", "bigint"), ("text", "string")]

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run(iter([batch]))


def now(key):
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(key)) / 1024


path = public_tokenizers.path("word_bpe_49k.json")
packing.words(path)
before = now("VmRSS")
open("/proc/self/clear_refs", "w").write("5")  # the peak starts anew
pieces = sum(len(b.column("doc")[0]) for b in packing.pieces(Docs(), path, "doc_id", "text"))
print(pieces, now("VmHWM") - before)
"""


def test_tokenising_holds_little():
    found = subprocess.run([sys.executable, "-c", CHILD], capture_output=True, text=True, check=True).stdout.split()
    assert int(found[0]) >= 2600 and float(found[1]) < 300
