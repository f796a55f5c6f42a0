"""What a task holds as Python strings is bounded by bytes, not by rows."""

import pyarrow as pa

from lodestone.llm.common import slices


def test_slices():
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": ["é" * 3, None, "", "x" * 50, "abc", "abcd", None]})
    for part in (batch, batch.slice(2, 4), batch.slice(7)):
        for most in (1, 6, 8, 1000):
            found = list(slices(part, most=most))
            assert sum((p.to_pylist() for p in found), []) == part.to_pylist()
            assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= most for p in found)
    assert len(list(slices(batch, most=8))) == 3
