"""Leaf-wise boosting against a brute-force version that looks at every split of every leaf."""

import numpy as np
import pytest

from clickloom.operators import boosting as b


def rows_of(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 9, n), rng.normal(size=n).round(2), rng.integers(0, 2, n), np.ones(n)], axis=1).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 4) * (2 * x[:, 2] - 1) - x[:, 1]))).astype(int)
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(i, int(label), [float(v) for v in row]) for i, (row, label) in enumerate(zip(x, y))], "sample_id long, label int, x array<double>").repartition(3)


def brute(bins, g, h, policy):
    """The sets of rows of the leaves, split best first; ties to the first feature and bin."""

    def best(rows):
        found = (0.0, -1, 0)
        score = lambda r: (g[r].sum() * b._UNIT) ** 2 / (h[r].sum() * b._UNIT)
        for f in range(bins.shape[1]):
            for t in range(bins[:, f].max()):
                left, right = rows[bins[rows, f] <= t], rows[bins[rows, f] > t]
                if min(len(left), len(right)) >= policy.min_leaf_rows:
                    gain = score(left) + score(right) - score(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, f, t)
        return found

    leaves = [(best(np.arange(len(bins))), np.arange(len(bins)))]
    while len(leaves) < policy.leaves:
        i = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
        (gain, f, t), rows = leaves[i]
        if gain <= 0:
            break
        leaves[i : i + 1] = [(best(r), r) for r in (rows[bins[rows, f] <= t], rows[bins[rows, f] > t])]
    return {tuple(rows) for _, rows in leaves}


@pytest.mark.parametrize("balanced", [False, True])
def test_trees_equal_brute_force(spark, balanced):
    x, y = rows_of()
    policy = b.LeafwisePolicy(trees=3, leaves=8, bins=16, subsample=1.0, column_share=1.0, save_every=2)
    model = b.fit_leafwise(frame(spark, x, y), balanced, policy)
    bins = np.stack([np.searchsorted(borders, x[:, i]) for i, borders in enumerate(model.borders)], axis=1)
    weight = (y == 0).sum() / (y == 1).sum() if balanced else 1.0
    margin = np.full(len(y), model.base)
    for tree in model.trees:
        g, h = b.gradients(margin, y, weight)
        leaf = tree.nodes(bins)
        assert {tuple(np.flatnonzero(leaf == n)) for n in set(leaf)} == brute(bins, g, h, policy)
        for n in set(leaf):
            assert tree.value[n] == pytest.approx(-policy.learning_rate * g[leaf == n].sum() / h[leaf == n].sum())
        tree.add_to(margin, bins)
    assert sum(model.split_counts) == sum(sum(f >= 0 for f in t.feature) for t in model.trees) and model.split_counts[3] == 0


def test_reruns_agree_and_scores_separate(spark):
    x, y = rows_of()
    policy = b.LeafwisePolicy(trees=6, leaves=8, learning_rate=0.3, save_every=3)
    found = []
    for parts in (2, 5):
        df = frame(spark, x, y).repartition(parts)
        model = b.fit_leafwise(df, policy=policy)
        found.append({r.sample_id: r.p for r in df.select("sample_id", model.score(df.x).alias("p")).collect()})
    assert found[0] == found[1]
    p = np.array([found[0][i] for i in range(len(y))])
    assert p[y == 1].mean() - p[y == 0].mean() > 0.2
    with pytest.raises(ValueError):
        b.fit_leafwise(df.where("label = 1"))


def test_rows_are_stored_in_blocks_and_the_smaller_child_is_counted(spark, monkeypatch):
    x, y = rows_of(2000)
    stored, asked = [], []
    keep, count = b._stored, b.histograms

    def histograms(rows, done, tree, wanted, *rest):
        asked.append((list(tree.left), list(wanted), count(rows, done, tree, wanted, *rest)))
        return asked[-1][2]

    monkeypatch.setattr(b, "_stored", lambda rows: stored.append(keep(rows)) or stored[-1])
    monkeypatch.setattr(b, "histograms", histograms)
    b.fit_leafwise(frame(spark, x, y), policy=b.LeafwisePolicy(trees=1, leaves=6, subsample=1.0, column_share=1.0))
    assert stored[0].count() == 3
    assert asked[0][2][0, 0, :, 2].sum() == 2000
    assert all(hist[0, :, 2].sum() <= 1000 for _, _, found in asked[1:] for hist in found)
