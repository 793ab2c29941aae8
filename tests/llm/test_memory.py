"""What a Python worker keeps after its task."""

import subprocess
import sys
from pathlib import Path

CODE = '''
import numpy as np
import pyarrow as pa
from flowgauge.llm.common import tidied, tidied_call

def resident():
    return next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmRSS")) >> 10

def work():
    parts = [np.ones(12_000) for _ in range(2000)]  # blocks that the C library keeps when they are freed
    pins = [np.ones(12_000) for _ in range(2)]
    return parts[0].sum(), pins

kept = []

def run(batches):
    for x in batches:
        total, pins = work()
        kept.append(pins)
        yield x + total

def measured(texts: pa.Array) -> pa.Array:
    kept.append(work()[1])
    return texts

before = resident()
assert list(tidied(run)(iter([1, 2]))) == [12_001, 12_002]
assert resident() < before + 60, resident() - before
assert tidied_call(measured)(pa.array([1])).to_pylist() == [1]
assert tidied_call(measured).__annotations__ == measured.__annotations__
assert resident() < before + 60, resident() - before
'''


def test_freed_memory_goes_back():
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
