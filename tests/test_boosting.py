"""Leaf-wise boosting and Shapley values against brute force."""

import heapq
import itertools
import math

import numpy as np
import pytest

from recspark.operators import boosting, ltr

NAMES = ("a", "b", "c", "d")


def brute_lambdas(score, label, truncation=30):
    """All pairs of one query, in plain loops."""
    order = sorted(range(len(score)), key=lambda i: (-round(score[i], 9), i))
    place = {i: n + 1 for n, i in enumerate(order)}
    push, bend, total = [0.0] * len(score), [0.0] * len(score), 0.0
    for t in range(len(score)):
        for n in range(len(score)):
            if label[t] and not label[n] and min(place[t], place[n]) <= truncation:
                change = abs(1 / math.log2(1 + place[t]) - 1 / math.log2(1 + place[n]))
                if max(score) != min(score):
                    change /= 0.01 + abs(score[t] - score[n])
                rho = 1 / (1 + math.exp(score[t] - score[n]))
                push[t] += rho * change
                push[n] -= rho * change
                bend[t] += rho * (1 - rho) * change
                bend[n] += rho * (1 - rho) * change
                total += 2 * rho * change
    scale = math.log2(1 + total) / total if total else 1.0
    return np.array(push) * scale, np.array(bend) * scale


def test_lambdas_equal_all_pairs():
    rng = np.random.default_rng(0)
    sizes = [1, 40, 7, 80, 5]
    ends = np.cumsum([0, *sizes])
    score, label = rng.normal(size=ends[-1]).round(1), np.zeros(ends[-1], int)
    for i in (0, 1, 2, 3):  # the last query has no target
        label[ends[i] + rng.integers(sizes[i])] = 1
    score[ends[2] : ends[3]] = 0.0
    push, bend = boosting.lambdas(score, label, ends)
    for lo, hi in zip(ends, ends[1:]):
        want = brute_lambdas(score[lo:hi].tolist(), label[lo:hi].tolist())
        assert np.allclose(push[lo:hi], want[0]) and np.allclose(bend[lo:hi], want[1])


def sums_of(bins, push, bend):
    out = np.zeros((bins.shape[1], boosting.BINS + 1, 3))
    for f in range(bins.shape[1]):
        for b, g, h in zip(bins[:, f], push, bend):
            out[f, b] += (g, h, 1)
    return out


def brute_tree(bins, push, bend, leaves, least):
    """Best-first growth that looks at every split of every leaf, one split at a time."""
    def best(rows):
        found = (0.0, None)
        for f in range(bins.shape[1]):
            for cut in range(int(bins[:, f].max()) + 1):
                left = rows[bins[rows, f] <= cut]
                right = rows[bins[rows, f] > cut]
                if min(len(left), len(right)) < least or min(bend[left].sum(), bend[right].sum()) < 1e-3:
                    continue
                gain = push[left].sum() ** 2 / bend[left].sum() + push[right].sum() ** 2 / bend[right].sum() - push[rows].sum() ** 2 / bend[rows].sum()
                if gain > found[0] + 1e-9:
                    found = (gain, (left, right))
        return found

    every = np.arange(len(bins))
    heap, count, done = [(-best(every)[0], 0, every)], itertools.count(1), []
    while heap and len(heap) + len(done) < leaves:
        gain, _, rows = heapq.heappop(heap)
        if gain >= 0:
            done.append(rows)
            continue
        for part in best(rows)[1]:
            heapq.heappush(heap, (-best(part)[0], next(count), part))
    return sorted(tuple(r.tolist()) for r in [*done, *(r for _, _, r in heap)])


def training(spark, users=30, rows=25, seed=2):
    rng = np.random.default_rng(seed)
    data = []
    for u in range(users):
        x = rng.normal(size=(rows, 4)).round(1)
        target = int(np.argmax(x[:, 0] + 0.7 * x[:, 1] * x[:, 2] + rng.normal(size=rows) * 0.3))
        data += [(u, i, int(i == target), *map(float, x[i])) for i in range(rows)]
    return spark.createDataFrame(data, "user_id bigint, item_id bigint, label int, " + ", ".join(f"{n} double" for n in NAMES))


def test_growth_equals_one_split_at_a_time(spark):
    matrix = training(spark)
    cuts = boosting.cut_points(matrix, NAMES, 12)
    blocks = boosting.pack(matrix, NAMES, cuts)
    rows = sorted((r["user_id"], r["item_id"], r["lambda"], r["hessian"]) for r in boosting.current_rows(blocks).collect())
    frame = {(r["user_id"], r["item_id"]): r for r in matrix.collect()}
    bins = np.array([[np.searchsorted(cuts[f], frame[u, i][n], side="left") for f, n in enumerate(NAMES)] for u, i, _, _ in rows])
    push, bend = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    grown = boosting.grow(blocks, 4, 9, 10)
    assert len(grown.kept) == 8
    tree = boosting.Growing([f if n in grown.kept else -1 for n, f in enumerate(grown.tree.feature)], grown.tree.cut, grown.tree.left, grown.tree.right)
    at = tree.place(bins)
    assert sorted(tuple(np.flatnonzero(at == n).tolist()) for n in np.unique(at)) == brute_tree(bins, push, bend, 9, 10)
    for n in np.unique(at):
        assert np.allclose(grown.sums[n], sums_of(bins[at == n], push[at == n], bend[at == n]))
    after = boosting.advance(blocks, grown, 0.1)
    want = {n: 0.1 * push[at == n].sum() / bend[at == n].sum() for n in np.unique(at)}
    got = sorted((r["user_id"], r["item_id"], r["score"]) for r in boosting.current_rows(after).collect())
    assert np.allclose([s for _, _, s in got], [want[n] for n in at])


def test_fit_has_the_leaves_asked_for_and_learns(spark):
    matrix = training(spark, users=60)
    model = ltr.lambdamart_fit(matrix, NAMES, {"num_leaves": 31, "learning_rate": 0.1, "n_estimators": 4, "min_child_samples": 5})

    def leaves(node):
        return 1 if node.feature is None else leaves(node.left) + leaves(node.right)

    assert [leaves(t) for t in model.trees] == [31] * 4
    ranked = ltr.ltr_rank(model, matrix, 5, contributions=True).cache()
    hits = ranked.join(matrix.filter("label = 1").select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").count()
    assert hits > 45 and ltr.contribution_gap(ranked).count() == 0


def grow_random(rng, depth):
    if not depth or rng.random() < 0.15:
        return ltr.Node(value=float(rng.normal()), rows=int(rng.integers(1, 9)))
    left, right = grow_random(rng, depth - 1), grow_random(rng, depth - 1)
    return ltr.Node(NAMES[rng.integers(4)], float(rng.normal()), left, right, rows=left.rows + right.rows)


def expected(node, row, known):
    """The tree's mean over the features that are not known, by its covers."""
    if node.feature is None:
        return node.value
    f = NAMES.index(node.feature)
    if f in known:
        return expected(node.left if row[f] <= node.threshold else node.right, row, known)
    return (node.left.rows * expected(node.left, row, known) + node.right.rows * expected(node.right, row, known)) / (node.left.rows + node.right.rows)


@pytest.mark.parametrize("seed", range(6))
def test_shapley_values_equal_all_subsets(seed):
    rng = np.random.default_rng(seed)
    trees = [grow_random(rng, 6) for _ in range(3)]
    x = rng.normal(size=(8, 4))
    x[0, 2] = np.nan
    paths = ltr.Paths(trees, NAMES)
    got = paths.values(x)
    for i, row in enumerate(x):
        value = lambda known: sum(expected(t, row, known) for t in trees)
        for f in range(4):
            others = [o for o in range(4) if o != f]
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value({*s, f}) - value(set(s)))
                       for n in range(4) for s in itertools.combinations(others, n))
            assert got[i, f] == pytest.approx(want, abs=1e-9)
        assert got[i].sum() + paths.bias == pytest.approx(ltr.Forest(trees, NAMES).walk(x)[i], abs=1e-9)
