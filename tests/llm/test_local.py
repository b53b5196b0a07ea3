"""Memory of Python workers."""

import resource
from pathlib import Path

import pyarrow as pa

from floorloom.llm.local import lean


def test_workers_give_back_what_they_free(spark):
    """A worker that freed a heap of small pieces kept them; what lies above them hides none of it from the system."""

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize()

    def crowd(batches):
        for batch in batches:
            small = [bytes(1000) for _ in range(200_000)]
            last = small[-1]
            del small
            yield pa.RecordBatch.from_arrays([pa.array([resident() + 0 * len(last)])], ["held"])

    def idle(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resident()])], ["held"])

    one = spark.range(1).coalesce(1)
    before = one.mapInArrow(lean(idle), "held long").first()["held"]
    one.mapInArrow(lean(crowd), "held long").collect()
    assert one.mapInArrow(idle, "held long").first()["held"] < before + 100_000_000


def test_lean_keeps_arguments():
    assert lean(lambda a: a + 1)(1) == 2 and lean(lambda a, b: a + b)(1, 2) == 3
    assert lean(lambda rows: (yield from rows))([1, 2]).__next__() == 1
