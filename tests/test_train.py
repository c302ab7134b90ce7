"""Training: losses against naive sums, gradients against differences, batches, sampling, labels, learning."""

import math

import numpy as np
import pytest

from kindred.operators import encode, ged, train
from kindred.operators.graphs import GRAPH

PATH = ([0, 1, 2], [(0, 1, 1), (1, 2, 1)])
STAR = ([1, 0, 0, 2], [(0, 1, 1), (0, 2, 1), (0, 3, 1)])
DOT = ([2], [])


def test_pair_loss_equals_its_naive_sum():
    rng = np.random.default_rng(1)
    x, t, bits = rng.normal(size=(4, 3)), np.abs(rng.normal(size=(4, 4))), np.array([1.0, -2.0, 0.5])
    want = 0.0
    for i in range(4):
        for j in range(i + 1, 4):
            d = min(sum(max(b, 0) * (a - c) ** 2 for a, c, b in zip(x[i], x[j], bits)), 1.5)
            want += math.exp(0.05 * (d - t[i, j])) * (d - t[i, j]) ** 2
    assert math.isclose(train.pair_loss(x, t, 1.5, 0.05, bits)[0], want / 16)


def test_other_losses_by_hand():
    c = np.array([[0.5, 0.5], [0.5, -0.5]])
    truth = np.array([[0.0, 20.0], [1.0, 0.0]])
    # distances 0 and 1; margin 1: the far pair (20) is at the margin, the near one (1) costs its distance
    assert math.isclose(train.similarity_loss(c, truth, 11), 1 / 4)
    assert math.isclose(train.similarity_loss(c, truth, 11, copies=np.zeros((2, 1, 2)), synthetic=2), 1 / 4 + 2 * 0.5)
    assert math.isclose(train.score_loss(np.array([[12.0, -1.0]]), np.array([[3.0]]), np.array([[2.0]]), 5, 1, 3), (4 + 3 * 4) / 2)
    assert train.binary_loss(c)[0] == 0 and train.l1_loss(c, 0.1)[0] == pytest.approx(0.2)
    scores, labels = np.array([[0.0, 0.0], [9.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 1.0]])
    assert train.masked_cross_entropy(scores, labels, np.array([1, 0])) == pytest.approx(math.log(2))
    assert train.masked_accuracy(scores, labels, np.array([1, 1])) == 0.5 and train.masked_accuracy(scores, labels, np.zeros(2)) == 0


def test_gradients_equal_differences():
    w = encode.make_weights(3, seed=5)
    s = train.Settings(limit=1e9, decay=0.01)
    batch, truth, edits = [PATH, STAR, DOT, STAR], np.array([[0, 3.0], [3.0, 0]]), np.array([[1.0], [2.0]])
    value, grads = train.loss_and_gradients(batch, truth, edits, w, s, np.linspace(0, 2, 32))
    rng = np.random.default_rng(2)
    for name, x in w.items():
        # along the gradient itself, so that the slope is large, and along a random direction
        for way in (grads[name] / np.linalg.norm(grads[name]), rng.normal(size=x.shape) / np.sqrt(x.size)):
            losses = []
            for step in (1e-6, -1e-6):
                moved = w | {name: x + step * way}
                losses.append(train.loss_and_gradients(batch, truth, edits, moved, s, np.linspace(0, 2, 32))[0])
            assert (losses[0] - losses[1]) / 2e-6 == pytest.approx(float((grads[name] * way).sum()), rel=2e-3, abs=1e-4 * max(1, abs(value))), name


def test_clipping_keeps_the_slope():
    x = np.array([[0.0], [3.0]])
    value, grad = train.pair_loss(x, np.array([[0, 2.0], [2.0, 0]]), 4)
    assert value == 4 / 4 and grad[1, 0] == 2 * (4 - 2) / 4 * 2 * 3


def test_cyclic_batches_deal_anew_at_the_end():
    g = train.cyclic_batches(5, 2, np.random.default_rng(0))
    one = [next(g) for _ in range(3)]
    assert [x.tolist() for x in one[:2]] == [[0, 1], [2, 3]] and one[2][0] == 4 and all(len(x) == 2 for x in one)
    assert len(next(train.cyclic_batches(3, 8, np.random.default_rng(0)))) == 8
    assert sorted(np.concatenate([next(g) for _ in range(2)]).tolist() + next(g)[:1].tolist()) == [0, 1, 2, 3, 4]


def test_proximity_sampling_follows_its_weights():
    d = np.array([[0, 0.1, 3.0, 900.0], [0.1, 0, 1, 1], [3.0, 1, 0, 1], [900.0, 1, 1, 0]])
    rng = np.random.default_rng(3)
    got = train.proximity_sample(d, 0, 4000, 4000, rng)
    assert got[0] == 0 and 0 not in got[1:]
    share = (got[1:4001] == 1).mean()
    assert abs(share - math.exp(-0.1) / (math.exp(-0.1) + math.exp(-3))) < 0.03 and (got[4001:] == 3).all()
    grown = train.proximity_sample(d, 0, 0, 4000, rng, grown=True)
    assert abs((grown[1:] == 2).mean() - 3 / 903.1) < 0.01
    assert set(train.proximity_sample(np.zeros((3, 3)), 1, 5, 5, rng, grown=True)[1:]) <= {0, 2}


def test_pool_slides_and_restarts():
    w = encode.make_weights(3)
    pool = train.Pool([PATH, STAR, DOT, PATH, STAR], 3, 2, w)
    assert np.allclose(pool.d[0, 1], ((pool.emb[0] - pool.emb[1]) ** 2).sum())
    pool.slide(w)
    assert pool.bias == 2 and np.allclose(pool.emb, pool._embed(np.array([2, 3, 4]), w))
    pool.slide(w)
    pool.slide(w)
    assert pool.bias == 0 and not pool.grown
    assert set(pool.sample(1, 4, np.random.default_rng(0))) <= {0, 1, 2}


@pytest.mark.parametrize("by_proximity", [False, True])
def test_training_lowers_the_loss(by_proximity):
    graphs = [PATH, STAR, DOT, ([0, 0], [(0, 1, 1)]), ([1, 2, 1], [(0, 1, 1)]), ([2, 2, 2, 2], [(0, 1, 1), (1, 2, 1), (2, 3, 1)])]
    s = train.Settings(batch=6, epochs=60, by_proximity=by_proximity, pool=6, step=2, refresh=10)
    start = encode.make_weights(3)
    w, losses = train.train(graphs, start, s)
    assert len(losses) == 60 and np.mean(losses[-5:]) < 0.5 * np.mean(losses[:5])
    assert np.allclose(start["conv0"], encode.make_weights(3)["conv0"]) and not np.allclose(w["conv0"], start["conv0"])
    assert train.train([], start)[1] == []


def test_stop_rule():
    s = train.Settings(long=4, short=2, gain=0.1, every=3)
    assert not train.stopped([1.0] * 4, s) and train.stopped([1.0] * 7, s)
    assert not train.stopped([9.0, 8, 7, 6, 5, 4, 3], s) and not train.stopped([1.0] * 8, s)


def test_batch_labels(spark):
    rows = [(1, 0, *_row(PATH)), (2, 0, *_row(STAR)), (3, 0, *_row(DOT)), (4, 1, *_row(PATH)), (5, 1, 0, 0, [], [])]
    g = spark.createDataFrame(rows, "gid long, b int, " + GRAPH.split(", ", 1)[1])
    got = {(r.qid, r.gid): r.ged for r in train.batch_labels(g, "b", 4).collect()}
    graph = {1: PATH, 2: STAR, 3: DOT, 4: PATH, 5: ([], [])}
    want = {}
    for i in graph:
        for j in graph:
            if (i <= 3) == (j <= 3):
                want[i, j] = min(ged.edit_distance(*graph[i], *graph[j]), 4)
    assert got == want
    assert train.batch_labels(g.limit(0), "b", 4).collect() == []
    assert len(train.train_sample(g)) == 4 and len(train.train_sample(g, 2)) == 2


def _row(g):
    return len(g[0]), len(g[1]), g[0], g[1]
