"""Pairs of vectors that share a direction with all of their label."""

import numpy as np

from tablewright.llm import vector_dedup


def test_common_direction(spark):
    rng = np.random.default_rng(5)
    dim, n, planted = 128, 4000, 100

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    common = np.zeros(dim)
    common[0] = 1
    side = rng.standard_normal((n, dim))
    side[:, 0] = 0
    side = unit(side)
    turn = rng.standard_normal((planted, dim))
    turn[:, 0] = 0
    turn -= np.einsum("ij,ij->i", turn, side[:planted])[:, None] * side[:planted]
    other = 0.7 * side[:planted] + 0.51**0.5 * unit(turn)
    made = 0.95**0.5 * common + 0.05**0.5 * np.vstack([side, other])
    cosine = unit(made) @ unit(made).T
    np.fill_diagonal(cosine, 0)
    assert ((cosine >= 0.98).sum(axis=1) > 0).sum() == 2 * planted
    rows = [(i, v.tolist(), 1) for i, v in enumerate(made)]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    got = {r._id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(vectors).collect()}
    found = sum(got[n + i] == (1, i) and got[i] == (1, i) for i in range(planted))
    assert found >= 0.99 * planted, found
