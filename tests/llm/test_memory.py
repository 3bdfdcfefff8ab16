"""Bytes that a worker holds: blocks, slices, copies of the sample, and Python workers that one task needs at once."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkdemand.llm import language, suffix_dedup
from sparkdemand.llm.common import slices


def peak_of(work):
    tracemalloc.start()
    try:
        made = work()
        return made, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_run_finding_holds_little_for_a_block():
    suffix_dedup._tables.cache_clear()
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, suffix_dedup.BLOCK, dtype=np.uint8).tobytes()
    found, peak = peak_of(lambda: suffix_dedup.find_runs([text[: len(text) // 2], text[len(text) // 2 :]]))
    assert len(found[0]) and peak < 12e6


def test_ranks_need_no_second_copy():
    rng = np.random.default_rng(3)
    b = rng.integers(97, 99, 200_000, dtype=np.uint8)
    want = np.unique(b.astype(np.int64), return_inverse=True)[1]
    assert (suffix_dedup._dense(b.astype(np.int64)) == want).all()
    _, peak = peak_of(lambda: suffix_dedup._ranks(b, 400))
    assert peak < 60 * len(b)


def test_fit_does_not_copy_the_sample():
    rng = np.random.default_rng(4)
    x = np.zeros((300, language.SIZE + 1), np.float32)
    for row in x:
        row[rng.integers(0, language.SIZE, 200)] = 0.15
    x[150:, 7], x[:, -1] = 1, 1
    y = np.where(np.arange(300) < 150, 1, -1).astype(np.float32)
    (weights, bias), peak = peak_of(lambda: language.fit_pair(x, y))
    assert ((x[:, :-1] @ weights + bias > 0) == (y > 0)).all()
    assert len(weights) == language.SIZE and peak < x.nbytes / 2


def test_slices_hold_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1300))], ["a"])
    parts = list(slices([batch, batch.slice(0, 0), batch.slice(0, 5)]))
    assert [p.num_rows for p in parts] == [512, 512, 276, 5]
    assert sum((p.column(0).to_pylist() for p in parts), []) == [*range(1300), *range(5)]


def workers_at_once(plan) -> int:
    """Most Python nodes between two shuffles of a physical plan."""

    def walk(node):
        below = [walk(node.children().apply(i)) for i in range(node.children().size())]
        most = max((m for m, _ in below), default=0)
        here = max((h for _, h in below), default=0)
        name = node.nodeName()
        here = 0 if "Exchange" in name and "Broadcast" not in name else here + ("Python" in name or "InArrow" in name or "Pandas" in name)
        return max(most, here), here

    return walk(plan.initialPlan() if plan.nodeName().startswith("Adaptive") else plan)[0]


def test_one_python_worker_a_task(docs):
    for df in (suffix_dedup.repeat_digest(docs), suffix_dedup.cut_repeats(docs.drop("key"), length=200)):
        assert workers_at_once(df._jdf.queryExecution().executedPlan()) == 1
