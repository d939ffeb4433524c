import collections
import random

import numpy as np
import pytest

from colloquy.llm import quality_rules as q


def brute_counts(text):
    w, lines = (text or "").split(), [x for x in (text or "").split("\n") if x.split()]
    grams = list(zip(w, w[1:], w[2:]))
    often, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def corpus():
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 300)), "en" if i % 5 else "fr", f"s{i % 3}") for i in range(700)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(100).split()), "en", "s0") for i in range(40)]
    rows += [(2000 + i, prose(100).upper().replace(" ", "!! "), "fr", None) for i in range(5)]
    return rows + [(3000, None, None, None), (3001, "", "en", "s0"), (3002, "a b c a b c a b c " * 20, "en", "s0"), (3003, "x\nx\nx y\x0b\n \n", "en", "s0"), (0, rows[0][1], "en", "s0"), (3004, "w " * 200000, "xx", "s9")]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").withColumns({"kept": q.F.lit("mine"), "n": q.F.lit(1), "m0": q.F.lit(2)})
    return df, q.quality_rules(df).toPandas()


def test_counts_and_verdicts(judged):
    _, got = judged
    for r in got.itertuples():
        n, chars, symbols, dup, again = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and not (r.base_failed and r.kept)
    assert len(got) == len(corpus())
    assert got[got.doc_id < 1000].kept.all() and not got[got.doc_id >= 1000].kept.any()


def test_estimate_is_minimum_covariance(spark, judged):
    """The same steps in numpy, for the one cell that all documents of this corpus share."""
    df, got = judged
    rules = q.Rules(min_cell=10**6)
    x = np.array([[r[c] for c in q.X] for r in q.materialize(q.with_statistics(df), "test-stats").where("not base_failed").select(*q.X).collect()], dtype=float)
    floors = np.array(rules.floors) * q.UNIT

    def estimate(rows):
        cov = rows.T @ rows / len(rows) - np.outer(rows.mean(0), rows.mean(0))
        return rows.mean(0), np.linalg.inv(cov + np.diag(floors**2))

    bins = lambda d: np.floor(np.log2(d + 1) * 64)
    distances = lambda m, p: np.einsum("ij,jk,ik->i", x - m, p, x - m)
    lo, mid, hi = (np.percentile(x, p, axis=0) for p in (25, 50, 75))
    spread = np.maximum((hi - lo) / 1.349, floors)
    z, results = (x - mid) / spread, []

    def shape(u):
        cov = np.cov(np.rint(u * q.UNIT).T, bias=True) + np.eye(q.DIMS) * (0.05 * q.UNIT) ** 2
        return np.linalg.inv(cov) * q.UNIT**2 / np.outer(spread, spread)

    def step(m, p):
        d = bins(distances(m, p))
        return estimate(x[d <= np.floor(np.percentile(d, 50))])

    for start in (np.diag(1 / spread**2), shape(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)), shape(np.tanh(z))):
        m, p = mid, start
        for _ in range(rules.steps):
            m, p = step(m, p)
        results.append((-np.linalg.slogdet(p)[1], m, p))
    least, m, p = min(results, key=lambda r: r[0])
    while True:
        m2, p2 = step(m, p)
        if -np.linalg.slogdet(p2)[1] >= least - rules.tolerance:
            break
        least, m, p = -np.linalg.slogdet(p2)[1], m2, p2
    assert least <= min(r[0] for r in results)
    d = distances(m, p)
    scale = 2 ** (np.percentile(bins(d), 50) / 64) / q.CHI2_MEDIAN
    m, p = estimate(x[d <= q.CHI2_975 * max(scale, 0.1)])
    want = np.sort(np.sqrt(np.einsum("ij,jk,ik->i", x - m, p, x - m)))
    ours = np.sort(q.quality_rules(df, rules).where("distance is not null").toPandas().distance)
    np.testing.assert_allclose(ours, want, rtol=1e-6)


def test_nothing_passes_the_base_rules(spark, judged):
    df, _ = judged
    got = q.quality_rules(df.where("doc_id in (3000, 3001)").repartition(3)).collect()
    assert len(got) == 2 and not any(r["kept"] for r in got)


def test_correlated_junk_does_not_carry_the_estimate(spark):
    """A third of a cell is tight, correlated junk: the half of least determinant leaves it out."""
    rng = np.random.default_rng(8)
    clean = rng.normal(0, 300, (1400, q.DIMS)) + 2000
    junk = np.outer(rng.normal(0, 1, 600), np.full(q.DIMS, 900)) + rng.normal(0, 60, (600, q.DIMS)) + 5200
    rows = [("c", *map(int, v)) for v in np.vstack([clean, junk])]
    members = spark.createDataFrame(rows, "__cell string, " + ", ".join(f"{x} long" for x in q.X))
    found = q.least_determinant(members, q.Rules()).first()
    assert all(abs(found[m] - 2000) < 60 for m in q.M)
