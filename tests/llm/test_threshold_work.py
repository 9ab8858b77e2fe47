"""What the phases of the top-k search compute, and that they leave nothing out."""

import numpy as np
import pyarrow as pa
from skein.llm import uniform_threshold as ut


def batch(ids, x):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(x / 256), pa.list_(pa.float64()))], ["vec_id", "v"])


def search(ids, x, queries, k=5):
    """The phases on one machine: entries of each query, and the work."""
    side, work = ut._Side(ids[queries], x[queries].astype(np.float64)), {}
    batches = lambda: iter([batch(ids[i : i + 3000], x[i : i + 3000]) for i in range(0, len(ids), 3000)])
    q, _, s = ut.gather(batches(), side, k, work).shrink()
    cutoff = np.array([s[q == i].min() if (q == i).sum() == k else -np.inf for i in range(len(queries))])
    q, found, s = ut.collect(batches(), side, cutoff, k, work).shrink()
    return {int(ids[queries][i]): sorted(zip((-s[q == i]).tolist(), found[q == i].tolist(), strict=True)) for i in range(len(queries))}, work


def exact(ids, x, queries, k=5):
    scores = x[queries].astype(np.int64) @ x.astype(np.int64).T
    out = {}
    for row, own in zip(scores, ids[queries], strict=True):
        ranked = sorted((-int(v), int(i)) for v, i in zip(row, ids, strict=True) if i != own)[:k]
        out[int(own)] = [(float(v), i) for v, i in ranked]
    return out


def test_phases_are_exact_and_read_fewer_entries_than_all_pairs():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    ids, queries = np.arange(6000), np.arange(0, 6000, 50)
    got, work = search(ids, x, queries)
    assert got == exact(ids, x, queries)
    pairs = len(queries) * len(ids)
    assert work["gathered"] < 0.4 * ut.LISTS * pairs  # one list in four, and the entries that are resolved
    assert work["gathered"] + work["collected"] + work["resolved"] < 0.9 * ut.LISTS * pairs
    assert work["resolved"] < 0.1 * pairs


def test_ties_negative_scores_and_few_rows():
    rng = np.random.default_rng(6)
    x = np.floor(rng.integers(-3, 1, size=(300, 7)).astype(float))
    x[100:] = x[:200]  # repeated vectors
    ids, queries = np.arange(300)[::-1].copy(), np.arange(0, 300, 10)
    assert search(ids, x, queries)[0] == exact(ids, x, queries)
    few = search(ids[:4], x[:4], np.array([0, 2]))[0]
    assert few == exact(ids[:4], x[:4], np.array([0, 2])) and all(len(v) == 3 for v in few.values())
