"""Exact dedup: what a task holds of a long run."""
import types

import pyarrow as pa

from ranklab.llm import exact_dedup


def test_a_long_run_of_copies_keeps_no_text(monkeypatch):
    monkeypatch.setattr(exact_dedup, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    peak = []

    def batches():
        for i in range(40):
            b = pa.record_batch({"_t": pa.array([b"x" * 100_000] * 10, pa.binary()), "_s": pa.array([b"d"] * 10, pa.binary()), "_id": pa.array(range(10 * i, 10 * i + 10)),
                                 "_row": pa.array([{"id": j} for j in range(10 * i, 10 * i + 10)])})
            sent = b.serialize()
            yield pa.ipc.read_record_batch(sent, b.schema)
            peak.append(pa.total_allocated_bytes())

    before = pa.total_allocated_bytes()
    got = [r for b in exact_dedup._compare(False)(batches()) for r in b.to_pylist()]
    assert [r["row"]["id"] for r in got] == list(range(400))
    assert {(r["size"], r["first_id"]) for r in got} == {(400, 0)}
    assert max(peak) - before < 8 << 20          # of 40 MB of text
