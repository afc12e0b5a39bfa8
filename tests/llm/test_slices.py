"""Python workers hold a batch of texts and little beside it."""

import itertools
import random

import pyarrow as pa

from tesserae.llm import exact_dedup
from tesserae.llm.slices import SLICE_BYTES, slices


def test_combined_copies_leave_in_small_batches():
    rng = random.Random(4)
    texts = [str(rng.random()) * 12_000 for _ in range(40)] + ["", "x"]
    rows = [(t, i if i % 5 else None) for i, t in enumerate(texts * 2)] + [("lone", None)]
    rng.shuffle(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([i for _, i in rows], pa.int64())], names=["body", "id"])
    for keep, best in (("max", max), ("min", min)):
        made = list(exact_dedup._combine_batches(keep)(iter([batch, batch.slice(0, 0)])))
        assert max(b.num_rows for b in made) < 10 and len(made) > 4  # some 230 KB each
        want = {}
        for t, i in rows:
            want.setdefault(t, []).append(i)
        got = [r for b in made for r in b.to_pylist()]
        assert {r["body"]: (r["ids"], r["best"], r["n"]) for r in got} == {t: (m, best((x for x in m if x is not None), default=None), len(m)) for t, m in want.items()}
        assert len(got) == len(want)


def test_slices_hold_all_rows_in_order():
    big, none = "y" * (3 * SLICE_BYTES), [None, "", None]
    cases = [[], none, [big], [*none, big, *none, big, big, "z"], ["a" * (SLICE_BYTES // 3)] * 10, ["k"] * 5000]
    for texts in cases:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "t"])
        parts = list(slices(iter([batch, batch]), "t"))
        assert [r for p in parts for r in p.to_pylist()] == batch.to_pylist() * 2
        for p in parts:
            sizes = [len(t or "") for t in p["t"].to_pylist()]
            assert sum(sizes) <= 2 * SLICE_BYTES or len([x for x in sizes if x]) <= 2 or max(sizes) > SLICE_BYTES
        assert all(p.num_rows for p, _ in itertools.pairwise(parts)) or not texts
