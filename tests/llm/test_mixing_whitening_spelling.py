"""Source mixing, whitening and spelling variants against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recspark.llm import mixing, queries, spelling, whitening

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string, target int, origin string, word string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "o", "w", 1) for i, t, s in rows], SCHEMA)


# --- mixing ------------------------------------------------------------------------------

def expected_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    open_, target, left = set(names), dict.fromkeys(names, 0.0), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        for s in open_:
            target[s] = most * sizes[s] if s in over else unit * weight[s]
        if not over:
            break
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def mixed(df, **settings):
    return [r.asDict() for r in mixing.mix(df, **settings).collect()]


def assert_mix(rows, slack):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    target = expected_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-12)
    for s, t in target.items():
        assert abs(taken[s] - t) <= slack[s] / 2 + 1e-6
    return target


def test_mix_meets_its_targets(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixed(df)
    least = {}
    for r in rows:
        if r["size"]:
            least[r["source"]] = min(least.get(r["source"], 1 << 60), r["size"])
    # Rounding is carried to smaller sizes; the last one may be full, then the next larger is off.
    assert_mix(rows, {s: 40 * v for s, v in least.items()})
    key = lambda rows: sorted((r["doc_id"], r["size"], r["taken"]) for r in rows)
    assert len(rows) == df.count() and key(rows) == key(mixed(df.repartition(5)))


def test_rates_are_the_capped_tilt(spark):
    rng = np.random.default_rng(1)
    rows = mixed(docs(spark, [(i, "w " * int(n), f"s{i % 4}") for i, n in enumerate(rng.integers(1, 300, 400))]))
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        x, t = np.array([r["size"] for r in own], float), own[0]["target"]
        if t >= 2 * x.sum():
            assert all(r["rate"] == 2 for r in own)
            continue
        low, high = -100.0, 100.0
        for _ in range(200):  # the dual by bisection
            mid = (low + high) / 2
            low, high = (mid, high) if (x * np.minimum(2, np.exp(np.minimum(mid * x / x.mean(), 5)))).sum() < t else (low, mid)
        assert np.allclose([r["rate"] for r in own], np.minimum(2, np.exp(np.minimum(mid * x / x.mean(), 5))), rtol=1e-6)


def test_mix_edge_rows(spark):
    assert mixed(docs(spark, [])) == []
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixed(docs(spark, [(1, None, "a"), (2, " \t\x0b", None), (None, "", "b")])))
    rows = mixed(docs(spark, [(1, "a b", "b"), (1, "a b", "b"), (None, "c" * 9, None), (2, None, "b"), (3, "x y z", "ä"), (4, "w " * 50000, "z")]))
    assert len(rows) == 6 and sorted(r["size"] for r in rows) == [0, 1, 2, 2, 2, 50000]
    assert_mix(rows, {"b": 2, None: 1, "ä": 2, "z": 50000})
    assert [r["source"] for r in rows if r["doc_id"] is None] == [None]


def test_hot_groups_are_dealt(spark):
    df = docs(spark, [(i, "a b c", "hot" if i % 3 else f"s{i % 5}") for i in range(900)])
    assert_mix(mixed(df, hot=50), dict.fromkeys(["hot", *(f"s{i}" for i in range(5))], 3))


# --- whitening ---------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "c", 1) for i, v in rows], "vec_id long, embedding array<double>, label int, component string, x int")


def brute_whiten(rows, kept=16):
    """Plain numpy over the distinct integer vectors."""
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(v) for _, v in x}), dtype=np.int64)
    n, sums = len(fit), [sum(int(a) for a in col) for col in fit.T]
    center = (fit * n - np.array(sums)).astype(float) / n
    e, q = np.linalg.eigh(center.T @ center / n)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, v in x:
        far = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        y = np.array([(n * a - s) / n for a, s in zip(v, sums)])
        for k in range(min(kept, len(e))):
            out.setdefault((i, k + 1), []).append((n, far, (y @ q[:, k]) / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 20)) * np.linspace(0.5, 4, 20) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(300 + i, base[7].tolist()) for i in range(200)]
    rows += [(900, None), (901, [1.0] * 19 + [None]), (902, [math.nan] * 20), (903, [math.inf] * 20), (7, base[8].tolist())]
    got, want, sign = {}, brute_whiten(rows), {}
    for r in whitening.whiten(vectors(spark, rows)).collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
        assert r["identity_error"] < 1e-9
    assert got.keys() == want.keys() and len(got) == 500 * 16
    for key, own in got.items():
        a = sorted(own, key=lambda r: (r["deviation"], r["whitened"]))
        b = sorted(want[key], key=lambda r: r[1])
        for r, (n, far, value, share) in zip(a, b, strict=True):
            assert (r["n"], r["deviation"]) == (n, far) and r["explained"] == pytest.approx(share, rel=1e-9)
            if abs(value) > 1e-6:
                s = sign.setdefault(key[1], math.copysign(1, r["whitened"] * value))
                assert r["whitened"] == pytest.approx(s * value, rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("values", [
    np.r_[np.ones(10), 2 * np.ones(8), 3 + 1e-9 * np.arange(14)], 1 + 1e-8 * np.arange(32), 2.0 ** -np.arange(32), np.r_[np.zeros(28), 1, 1, 2, 2.0], np.ones(32)])
def test_refinement_with_clusters(values):
    """Residuals and orthonormality far below a double's precision, clusters or not."""
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((32, 32)))[0]
    v = ((q * values) @ q.T).astype(np.longdouble)
    v = (v + v.T) / 2
    e, x = whitening.refined(v)
    assert np.abs(v @ x - x * e).max() < 1e-17 * np.abs(e).max() and np.abs(x.T @ x - np.eye(32)).max() < 1e-17
    assert (np.diff(e) <= 1e-17).all()


def test_exact_products():
    rng = np.random.default_rng(4)
    for top in (50, 1 << 21, 1 << 45):
        y = rng.integers(-top, top, (300, 5))
        levels = whitening.add(whitening.gram(y[:100]), whitening.gram(y[100:]))
        exact = sum(level.astype(object) << (20 * k) for k, level in enumerate(levels))
        assert (exact == y.astype(object).T @ y.astype(object)).all()


def test_whitening_edge_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, []), (2, None)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["identity_error"] is None and r["n"] == 1 and r["deviation"] == 0 for r in one)
    far = whitening.whiten(vectors(spark, [(1, [1e200, 1.0]), (2, [1e12, 0.0]), (3, [0.0, 1e12]), (4, [0.0, 0.0]), (5, [1.0]), (6, [3.0])])).collect()
    assert {r["vec_id"] for r in far} == {2, 3, 4, 5, 6}  # 1e200 has no long
    assert all(r["deviation"] is None for r in far if r["vec_id"] in (2, 3)) and all(r["whitened"] is not None for r in far)


# --- spelling ----------------------------------------------------------------------------

def brute_variants(rows, least=6, times=5, factor=5):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if ("a" <= c <= "z") or ("A" <= c <= "Z") or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
                run = ""
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= times}

    def cuts(w):
        return {w[:i] + w[i + 1 :] for i in range(len(w))}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return a in cuts(b) if len(a) < len(b) else b in cuts(a)

    form, many = {}, {}
    for a, n in words.items():
        own = [b for b in words if abs(len(a) - len(b)) <= 1 and near(a, b)]
        many[a] = len(own)
        best = min(own, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= factor * n else None
    out = []
    for a, n in words.items():
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, n, many[a], words.get(form[a])))
    return sorted(out)


def result(df, **settings):
    return sorted(tuple(r) for r in spelling.variants(df, **settings).select("word", "form", "root", "n", "n_near", "form_n").collect())


def changed(rng, word):
    at, c = int(rng.integers(len(word))), chr(int(rng.choice([*range(97, 103), 0xE9, 0xFF])))
    return [word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]][int(rng.integers(3))]


def test_variants_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdeé"), rng.integers(6, 9))) for _ in range(60)] + ["long" * 15 + "abc", "long" * 16, "x" * 66]
    texts = []
    for doc_id in range(120):
        words = []
        for w in rng.choice(base, 80, p=np.arange(1, len(base) + 1) / sum(range(len(base) + 1))):
            for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.5 else 0):
                w = changed(rng, w)
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        texts.append((doc_id if doc_id % 9 else None, " ".join(words)))
    texts += [(1, None), (2, ""), (3, "1 2 3"), (4, "z" * 70000 + " " + "z" * 69999), (4, "z" * 70000)] * 5
    wide = "long" * 16
    texts += [(200 + i, f"{wide} {wide[:-1]} {wide}q {wide[:20]}x{wide[21:-1]} {wide[:-2]}" + f" {wide}" * (40 * i)) for i in range(6)]
    df = docs(spark, [(i, t, "s") for i, t in texts])
    want = brute_variants(texts)
    assert any(r[1] for r in want) and any(len(r[0]) in (63, 64) and r[4] for r in want)
    assert result(df) == want


def test_chunked_ends_find_the_same(spark):
    rng = np.random.default_rng(8)
    words = sorted({"prefix" + "".join(rng.choice(list("abc"), 5)) for _ in range(200)})
    df = spark.createDataFrame([(w, int(n)) for w, n in zip(words, rng.integers(5, 500, len(words)))], "word string, n long")
    key = lambda letters: sorted(tuple(r) for r in spelling.near_words(df, cells=3, letters=letters).collect())
    assert key(150) == key(1 << 17) and len(key(150)) > 50


def test_variants_of_nothing(spark):
    assert result(docs(spark, [])) == [] and result(docs(spark, [(None, None, None)])) == []


def test_registered(spark):
    assert queries.op11_source_mixing(spark, DATA).columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert queries.op12_whitening(spark, DATA).where(F.col("identity_error") > 1e-4).count() == 0
