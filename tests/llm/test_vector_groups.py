"""Near copies in numbers, cut cells, null ids and mixed sizes against a plain version."""

import numpy as np
import pytest

from papyra.llm import vector_dedup


def plain(rows):
    ids = [2**63 - 1 if d is None else d for d, _, _ in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    groups = {}
    for i, (_, v, c) in enumerate(rows):
        if v is not None and c is not None:
            groups.setdefault((c, len(v)), []).append(i)
    for own in groups.values():
        x = np.array([rows[i][1] for i in own], dtype=float)
        norm = np.sqrt((x * x).sum(axis=1))
        a, b = np.nonzero(np.triu(x @ x.T / norm[:, None] / norm[None, :] >= 0.98, 1))
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            n[own[i]] += 1
            n[own[j]] += 1
            parent[root(own[i])] = root(own[j])
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), 2**63), ids[i])
    return sorted(((d, n[i], None if least[root(i)] == 2**63 - 1 else least[root(i)], least[root(i)] == ids[i]) for i, (d, _, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile", [4096, 150])
def test_large_group_of_near_copies(spark, tile):
    r = np.random.default_rng(9)
    f = lambda v: [float(np.float32(x)) for x in v]
    base, other = r.standard_normal((2, 24))
    rows = [(i, f(base + 0.11 * r.standard_normal(24)), 1) for i in range(2000)]
    rows += [(3000 + i, f(other + 0.2 * r.standard_normal(24)), i % 2) for i in range(300)]
    rows += [(4000 + i, f(r.standard_normal(24)), 1) for i in range(200)] + [(5000 + i, f(base[:9] + 0.1 * r.standard_normal(9)), 1) for i in range(50)]
    rows += [(None, rows[0][1], 1), (None, rows[2100][1], None), (6000, None, 1), (None, f(base + 0.1 * r.standard_normal(24)), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    found = vector_dedup.near_duplicates(df, tile=tile)
    assert sorted((tuple(x) for x in found.collect()), key=str) == plain(rows)


def test_names_that_collide_are_drawn_again(spark, monkeypatch):
    rows = [(i, [1.0, float(i % 3)], 1) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    hashed, drawn = vector_dedup.F.xxhash64, []

    def poor(*columns):
        if len(columns) == 3:
            drawn.append(1)
            return hashed(*columns) if len(drawn) > 1 else vector_dedup.F.lit(5).cast("long")
        return hashed(*columns)

    monkeypatch.setattr(vector_dedup.F, "xxhash64", poor)
    assert sorted((tuple(x) for x in vector_dedup.near_duplicates(df).collect()), key=str) == plain(rows)
    assert len(drawn) == 2
