"""Python workers outlive their tasks: what a task has freed goes back to the system."""

import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

common = pytest.importorskip("tidemark.llm._common")


def private_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_lean_gives_back_what_a_task_freed():
    pins = []

    def run(batches):
        for batch in batches:
            blocks = [np.ones(8000) for _ in range(4000)]  # 256 MB in pieces of 64 kB
            pins.append(np.ones(8000))  # what lies above the freed pieces keeps the heap from shrinking by itself
            del blocks
            yield batch

    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    before = private_mb()
    assert list(common.lean(run)(iter([batch]))) == [batch]
    assert private_mb() - before < 100
    before = private_mb()
    assert list(run(iter([batch]))) == [batch]
    assert private_mb() - before > 200  # else the allocator gives it back anyway and this shows nothing
