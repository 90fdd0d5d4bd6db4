"""Mixing against brute force: optimal rates, domains of any name, calibration on rows held out."""

import numpy as np
from pyspark.sql import functions as F

from placelake.llm import mixing


def members(spark, rng, n, k):
    p = rng.dirichlet(np.full(k, 0.4), n)
    return spark.createDataFrame([(i, int(t), [float(x) for x in row]) for i, (t, row) in enumerate(zip(rng.integers(0, 900, n), p, strict=True))], "doc_id long, tokens long, p array<double>")


def brute_force(t, p, targets, rounds=20_000):
    """Nonnegative least squares in the same norm, by very many steps in one place."""
    a = (t[:, None] * p).T  # domains x documents
    norm = np.linalg.inv(a @ p)
    r = y = np.ones(len(t))
    for k in range(rounds):
        new = np.maximum(0, y - p @ norm @ (a @ y - targets))
        r, y = new, new + k / (k + 3) * (new - r)
    return (a @ r - targets) @ norm @ (a @ r - targets)


def test_rates_are_optimal(spark):
    rng = np.random.default_rng(8)
    m = members(spark, rng, 120, 3)
    rows = m.orderBy("doc_id").collect()
    t, p = np.array([r.tokens for r in rows], dtype=float), np.array([r.p for r in rows])
    now = t @ p
    for targets in (now * [0.5, 1.5, 0.2], now * [0.0, 1.0, 1.0], np.array([0.0, 0.0, now.sum()]), np.array([-now[0], now[1] * 4, now[2]])):
        rated, residual = mixing.solve_rates(m, [float(x) for x in targets], rounds=40, tolerance=1e-6)
        r = np.array([x.rate for x in rated.orderBy("doc_id").collect()])
        got = t * r @ p
        assert (r >= 0).all() and np.isclose(residual, np.abs(got - targets).sum() / max(1, targets.sum()))
        norm = np.linalg.inv((t[:, None] * p).T @ p)
        off, start = ((x - targets) @ norm @ (x - targets) for x in (got, now))
        assert off <= brute_force(t, p, targets) + 5e-3 * start  # after 40 rounds
    same, residual = mixing.solve_rates(m, [float(x) for x in now])
    assert residual < 1e-9 and {x.rate for x in same.collect()} == {1.0}


def test_inverse():
    a = np.array([[4.0, 1, 0], [1, 3, 2], [0, 2, 5]])
    assert np.allclose(mixing.inverse(a.tolist()), np.linalg.inv(a), atol=1e-6)
    assert np.isfinite(mixing.inverse([[1.0, 1.0], [1.0, 1.0]])).all() and np.isfinite(mixing.inverse([[0.0]])).all()


def test_domains_of_any_name(spark):
    rng = np.random.default_rng(3)
    text = lambda k: " ".join([f"x{x}" for x in rng.integers(0, 500, 30)] + ["rotten!!!" if k % 3 == 0 else "sound"])
    docs = spark.createDataFrame([(k, text(k)) for k in range(240)] + [(900, None), (901, "  ")], "doc_id long, text string").withColumns({"w": F.lit(1), "p": F.lit("x"), "rate": F.lit(9)})
    labels = spark.createDataFrame([(k, "w`" if k % 3 == 0 else "h") for k in range(200)], "doc_id long, domain string")
    mixed = mixing.mix(docs, labels, {"h"})
    got = {r.doc_id: r for r in mixed.rated.collect()}
    assert mixed.domains == ["h", "w`"] and len(got) == 242 and mixed.residual < 0.05
    assert all((got[k].rate < 0.5) == (k % 3 == 0) for k in range(240)) and all(abs(got[k].rate - 1) < 0.2 for k in range(240) if k % 3)
    assert {r.doc_id for r in mixing.drop_unwanted(docs, labels, {"h"}).collect()} == {k for k in range(240) if k % 3} | {900, 901}
    assert mixing.mix(docs.limit(0), labels, {"h"}).rated.count() == 0 and mixing.mix(docs, labels.limit(0), {"h"}).residual == 0


def test_temperature_is_fitted_on_rows_held_out(spark):
    """Words that always stand together tell one thing many times over; the temperature takes that back."""
    rng = np.random.default_rng(5)
    words = [f"telling{j}" for j in range(12)]
    rows, labels = [], []
    for k in range(800):
        bad = k % 4 == 0
        rows.append((k, " ".join([f"x{x}" for x in rng.integers(0, 400, 25)] + (words if rng.random() < (0.9 if bad else 0.1) else []))))
        labels.append((k, "bad" if bad else "fine"))
    docs, told = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    model = mixing.fit(docs, told)
    assert model.temperature > 2
    p = mixing.posteriors(docs, model).collect()
    assert 0.55 < np.mean([max(r.p) for r in p]) < 0.95
