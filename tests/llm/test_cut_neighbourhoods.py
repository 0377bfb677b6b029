"""Neighbourhoods above nndescent.GROUP points, dense labels, hot groups, and the exact way behind the audit."""

import numpy as np

from barloom.llm import nndescent


def spread_out(n, seed=1):
    """Unit vectors around one direction, most of them further apart than half the linking angle."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24)) * 0.055
    x[:, 0] += 1
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, vecs, labels):
    return spark.createDataFrame([(i, v.tolist(), label) for i, (v, label) in enumerate(zip(vecs, labels))], "vec_id bigint, embedding array<double>, label string")


def truth(vecs):
    """(links of each vector, smallest index of its component) by all pairs of one label."""
    x = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = x @ x.T >= nndescent.THRESHOLD
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        low = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
        if (low == root).all():
            return near.sum(axis=1), root
        root = low


def recall(got, links):
    """Mean share of found links over vectors with few and with many links."""
    found = np.array([r.n_links for r in sorted(got, key=lambda r: r.vec_id)])
    assert (found <= links).all()
    return [float((found[own] / links[own]).mean()) for own in ((links > 0) & (links <= 32), links > 32) if own.any()]


def test_points_cut_apart_meet_in_another_round(spark):
    n = 400
    vecs = spread_out(n)
    heads = spark.createDataFrame([(i, "a", bytearray(v.tobytes()), 0.0) for i, v in enumerate(vecs)], "row bigint, part string, vec binary, wide double")
    hub = spark.createDataFrame([(i, 0, float(vecs[i] @ vecs[0]), True) for i in range(1, n)], nndescent.EDGES)
    sizes = spark.createDataFrame([(i, n) for i in range(n)], "u bigint, k int")
    met = [{(r.u, r.v) for r in nndescent.refine(heads, hub, sizes, turn, 0.4).collect()} for turn in (0, 1)]
    assert len(met[0] | met[1]) > 1.3 * len(met[0])


def test_hot_group_and_small_groups_in_one_label(spark):
    rng = np.random.default_rng(2)
    normal = lambda n: rng.normal(size=(n, 64)) / 8
    hot = normal(1) + 0.012 * rng.normal(size=(300, 64))
    small = np.repeat(normal(125), 4, axis=0) + 0.012 * rng.normal(size=(500, 64))
    vecs = np.concatenate([hot, small, normal(400)])[rng.permutation(1200)]
    links, root = truth(vecs)
    got = nndescent.near_duplicates(frame(spark, vecs, ["x"] * len(vecs))).collect()
    assert min(recall(got, links)) >= 0.98
    assert np.mean([r.component_id == root[r.vec_id] for r in got]) >= 0.98


def test_dense_label_of_spread_out_vectors(spark):
    """Few of the links lie within a class: most leaders have links to many others."""
    vecs = spread_out(250)
    links, root = truth(vecs)
    got = nndescent.near_duplicates(frame(spark, vecs, ["x"] * len(vecs))).collect()
    assert min(recall(got, links)) >= 0.95
    assert np.mean([r.component_id == root[r.vec_id] for r in got]) >= 0.98


def test_exact_way_finds_every_link(spark, monkeypatch):
    """No audit is passed, so every label is compared exactly in blocks."""
    monkeypatch.setattr(nndescent, "AUDIT_ROUNDS", 1)
    monkeypatch.setattr(nndescent, "MEMBERS", 16)
    monkeypatch.setattr(nndescent, "_short", lambda truth, found: {part for part, _ in truth.values()})
    vecs = spread_out(150, seed=3)
    links, root = truth(vecs)
    got = nndescent.near_duplicates(frame(spark, vecs, ["x"] * len(vecs))).collect()
    assert [r.n_links for r in sorted(got, key=lambda r: r.vec_id)] == links.tolist()
    assert all(r.component_id == root[r.vec_id] for r in got)


def test_recall_is_taken_vector_by_vector():
    hot = {i: ("a", 1000) for i in range(100)}
    lost = {100 + i: ("b", 1) for i in range(10)}
    found = {i: 1000 for i in hot} | {i: 0 for i in lost}
    assert nndescent._short(hot | lost, found) == {"b"}
    assert nndescent._short(hot | lost, found | {i: 1 for i in lost}) == set()
