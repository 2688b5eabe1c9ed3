"""Links between many blocks of vectors: pruned by bounds, read without a shuffle."""

import numpy as np
import pytest

from riskloom.llm import cover_tree


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _tree(x, first, axes=None):
    tree = cover_tree.Tree.built(np.arange(first, first + len(x)), np.ones(len(x), np.int64), x)
    tree.quick = None if axes is None else cover_tree.sketch(tree.x, axes)
    return tree


@pytest.mark.parametrize("spread", [0.0, 0.05, 0.2, 0.5, 5.0])
def test_first_level_leaves_few_pairs_and_loses_none(spread):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 24))
    x = _unit(centres[rng.integers(0, 20, 900)] + spread * rng.normal(size=(900, 24)))
    axes = cover_tree.leading(x)
    exact = x[:500] @ x[500:].T >= 0.95
    for shown in (axes, None):
        a, b = _tree(x[:500], 0, shown), _tree(x[500:], 500, shown)
        gain_a, gain_b, _ = cover_tree.traverse(a, b, np.sqrt(0.1), 0.95)
        assert (gain_a[np.argsort(a.ids)] == exact.sum(1)).all() and (gain_b[np.argsort(b.ids)] == exact.sum(0)).all()
    if spread == 5.0:  # no structure: the bound alone leaves hardly any pair to compare
        assert len(cover_tree.heads(_tree(x[:500], 0, axes), _tree(x[500:], 500, axes), np.sqrt(0.1), 0.95)[1]) < 500 * 400 / 50


def test_sketches_never_fall_below_the_product():
    x = _unit(np.random.default_rng(1).normal(size=(300, 30)))
    quick = cover_tree.sketch(x, cover_tree.leading(x)).astype(float)
    assert (quick @ quick.T >= x @ x.T - 1e-5).all()


def test_blocks_meet_without_a_shuffle_of_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    written = {}

    def spy(df, name):
        written.setdefault(name, df._jdf.queryExecution().toString())
        return staged(df, name)

    staged = cover_tree.staged
    monkeypatch.setattr(cover_tree, "staged", spy)
    x = np.random.default_rng(2).normal(size=(640, 6)).round(2)
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.n_links for r in cover_tree.link_vectors(frame).collect()}
    linked = _unit(x) @ _unit(x).T >= 0.95
    assert all(out[i] == n - 1 for i, n in enumerate(linked.sum(1)))
    plan = written["compared"].split("== Physical Plan ==")[1]
    assert "CartesianProduct" in plan and "Exchange" not in plan
