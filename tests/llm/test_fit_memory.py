"""What the toxicity fit holds at once on the driver, and that its figures are those of the plain formulas."""

import tracemalloc

import numpy as np

from stratiform.llm import toxic_spans


def _peak(work) -> int:
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_transitions_are_worked_out_one_at_a_time():
    scores = np.random.default_rng(1).normal(size=(4_096, 64))
    jumps = np.array([[0.5, -1.0], [-0.5, 0.25]])
    assert _peak(lambda: toxic_spans.pair_marginals(scores, jumps)) < 8 * scores.nbytes


def test_transition_counts_equal_those_of_all_paths():
    scores, jumps = np.array([[0.3, -1.2, 2.0]]), np.array([[0.5, -1.0], [-0.5, 0.25]])
    paths = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    weight = {p: np.exp(sum(s * x for s, x in zip(scores[0], p)) + jumps[p[0], p[1]] + jumps[p[1], p[2]]) for p in paths}
    total = sum(weight.values())
    want = np.zeros((2, 2))
    for p, w in weight.items():
        want[p[0], p[1]] += w / total
        want[p[1], p[2]] += w / total
    chance, counts = toxic_spans.pair_marginals(scores, jumps)
    assert np.allclose(counts, want)
    assert np.allclose(chance[0], [sum(w for p, w in weight.items() if p[i]) / total for i in range(3)])


def test_documents_of_a_feature_are_counted_in_parts():
    rows = np.repeat(np.arange(3_000), 100)
    slots = np.random.default_rng(2).integers(0, toxic_spans.SLOTS, (5, len(rows)), dtype=np.int32)
    slots[0] = 7
    found = []
    assert _peak(lambda: found.append(toxic_spans._document_counts(slots, rows))) < 40 << 20
    assert found[0][7] == 3_000
    pairs = np.unique(np.concatenate([rows.astype(np.int64) * toxic_spans.SLOTS + s for s in slots]))
    assert (found[0] == np.bincount(pairs % toxic_spans.SLOTS, minlength=toxic_spans.SLOTS)).all()
