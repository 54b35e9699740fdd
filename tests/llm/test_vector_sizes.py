"""Vectors are compared with all others of their own size."""

import itertools

import numpy as np

from papyra.llm import vector_dedup


def test_each_size_links_within_itself(spark):
    r = np.random.default_rng(8)
    base = {n: r.standard_normal((3, n)) for n in (1, 3, 5, 10)}
    rows = [(i, (base[n][i % 3] + r.standard_normal(n) * r.choice([0.0, 0.05, 0.2])).tolist(), i % 2) for i, n in enumerate([1, 3, 5, 10] * 25)]
    rows += [(500, r.standard_normal(40).tolist(), 0), (501, [], 0)]  # a stray longer row, and one without components
    links, least = {d: 0 for d, *_ in rows}, {d: d for d, *_ in rows}
    for (a, u, k), (b, v, m) in itertools.combinations(rows, 2):
        if k == m and len(u) == len(v) and u and np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)) >= 0.98:
            links[a], links[b] = links[a] + 1, links[b] + 1
            old, new = max(least[a], least[b]), min(least[a], least[b])
            least = {d: new if c == old else c for d, c in least.items()}
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()
    assert sorted(map(tuple, found)) == sorted((d, links[d], least[d], least[d] == d) for d, *_ in rows)
    assert all(any(links[d] for d, v, _ in rows if len(v) == n) for n in (1, 3, 5, 10)) and not links[500]
