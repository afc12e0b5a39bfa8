"""Communities against planted groups, and their modularity against a plain greedy run."""

import numpy as np
import pytest

from tesserae.operators import leiden


def planted(groups, size, inside, outside, seed=3):
    rng = np.random.default_rng(seed)
    n = groups * size
    a = rng.random((n, n)) < np.where(np.arange(n)[:, None] // size == np.arange(n)[None] // size, inside, outside)
    return [(int(i) * 7 + 1, int(j) * 7 + 1, 1.0) for i, j in zip(*np.nonzero(np.triu(a, 1)), strict=True)]


def plain_modularity(rows, label, resolution=1.0):
    total = sum(w for *_, w in rows)
    k = {}
    for a, b, w in rows:
        for x in (a, b):
            k[label[x]] = k.get(label[x], 0.0) + w
    return sum(w for a, b, w in rows if label[a] == label[b]) / total - resolution * sum(v * v for v in k.values()) / (4 * total * total)


def plain_louvain(rows):
    """Node by node, then communities as nodes, until nothing moves."""
    near, total = {}, 2 * sum(w for *_, w in rows)
    for a, b, w in rows:
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0) + w
        near.setdefault(b, {})[a] = near.get(b, {}).get(a, 0) + w
    k = {i: sum(ws.values()) for i, ws in near.items()}
    member = {i: i for i in near}
    while True:
        label, size, changed = {i: i for i in near}, dict(k), False
        moving = True
        while moving:
            moving = False
            for i in sorted(near):
                size[label[i]] -= k[i]
                score = {label[i]: 0.0}
                for j, w in near[i].items():
                    if j != i:
                        score[label[j]] = score.get(label[j], 0.0) + w
                to = max(score, key=lambda c: (round(score[c] - k[i] * size[c] / total, 9), c == label[i]))
                moving |= to != label[i]
                changed |= to != label[i]
                label[i] = to
                size[to] += k[i]
        member = {i: label[c] for i, c in member.items()}
        if not changed:
            return member
        joined, sums = {}, {}
        for i in near:
            sums[label[i]] = sums.get(label[i], 0.0) + k[i]
            for j, w in near[i].items():
                row = joined.setdefault(label[i], {})
                row[label[j]] = row.get(label[j], 0.0) + w
        near, k = joined, sums


def test_planted_groups(spark):
    rows = planted(6, 20, 0.5, 0.01)
    # Rows in either direction are added up; loops and weights of 0 count for nothing.
    odd = [(b, a, w / 2) for a, b, w in rows] + [(a, b, w / 2) for a, b, w in rows] + [(1, 1, 50.0), (1, 800, 0.0)]
    frame = spark.createDataFrame(odd, "src long, dst long, w double")
    found = leiden.communities(frame)
    got = {r["id"]: r["label"] for r in found.collect()}
    assert got == {i * 7 + 1: (i // 20 * 20) * 7 + 1 for i in range(120)}
    assert abs(leiden.modularity(frame, found) - plain_modularity(rows, got)) < 1e-9


def test_a_ring_of_cliques_needs_levels(spark):
    # Thirty cliques of four, each tied to the next: pairs of them are merged at the best modularity.
    rows = [(c * 4 + i, c * 4 + j, 1.0) for c in range(30) for i in range(4) for j in range(i + 1, 4)] + [(c * 4, (c + 1) % 30 * 4 + 1, 1.0) for c in range(30)]
    got = {r["id"]: r["label"] for r in leiden.communities(spark.createDataFrame(rows, "src long, dst long, w double")).collect()}
    assert all(len({got[c * 4 + i] for i in range(4)}) == 1 for c in range(30))
    assert plain_modularity(rows, got) >= plain_modularity(rows, plain_louvain(rows)) - 0.02
    # Every community hangs together.
    for label in set(got.values()):
        seen, todo = set(), [label]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += [b if a == i else a for a, b, _ in rows if i in (a, b) and got[a] == got[b] == label]
        assert seen == {i for i, c in got.items() if c == label}


@pytest.mark.parametrize("rows", [[], [(1, 2, 1.0)]])
def test_small_graphs(spark, rows):
    got = {r["id"]: r["label"] for r in leiden.communities(spark.createDataFrame(rows, "src long, dst long, w double")).collect()}
    assert got == ({1: 1, 2: 1} if rows else {})
