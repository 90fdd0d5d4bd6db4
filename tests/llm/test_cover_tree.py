"""Near vectors against brute force where labels are larger than a block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelake.llm import covertree

SCHEMA = "vec_id long, label string, embedding array<double>"


def brute_force(rows, cosine=0.93):
    good = [(i, l, np.array(v, float) / np.linalg.norm(v)) for i, l, v in rows if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {i: (0, i) for i, _, _ in rows if i is not None}
    for label in {(l, len(v)) for _, l, v in good}:
        ids = [i for i, l, v in good if (l, len(v)) == label]
        x = np.stack([v for _, l, v in good if (l, len(v)) == label])
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        root = dict(zip(ids, ids, strict=True))
        left = set(range(len(ids)))
        while left:
            own, todo = set(), [left.pop()]
            while todo:
                k = todo.pop()
                own.add(k)
                new = set(np.flatnonzero(near[k]).tolist()) & left
                left -= new
                todo += new
            for k in own:
                root[ids[k]] = min(ids[j] for j in own)
        for k, i in enumerate(ids):
            out[i] = (int(near[k].sum()), root[i])
    return out


@pytest.fixture
def small_blocks(monkeypatch):
    """Splitting runs on the driver's plans; nodes of 120 are large then."""
    monkeypatch.setattr(covertree, "BLOCK", 120)
    monkeypatch.setattr(covertree, "SAMPLE", 80)


@pytest.mark.parametrize("spread", [0.12, 3.0])
def test_links_across_blocks(spark, small_blocks, spread):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 10))
    rows = [(k, f"l{k % 7 == 0}", (base[k % 40] + rng.normal(size=10) * spread).tolist()) for k in range(700)]
    rows += [(1000 + k, "lFalse", rows[5][2]) for k in range(150)] + [(None, "lFalse", rows[5][2]), (2000, "lFalse", None), (2001, None, rows[5][2]), (2002, "lFalse", [0.0] * 10), (2003, "one", [1.0, 2.0])]
    got = covertree.near_vectors(spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit(1), "unit": F.lit(2), "pair": F.lit("x")})).collect()
    want = brute_force(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and [r.n_links for r in got if r.vec_id is None] == [0]


def test_vectors_closer_than_rounding(spark, small_blocks):
    rows = [(k, "a", [1.0, 1e-12 * k, 0.5]) for k in range(300)]
    got = covertree.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 300 and {(r.n_links, r.component_id) for r in got} == {(299, 0)}


def test_clustered_labels_prune(spark, small_blocks):
    """Of clusters far apart, blocks meet few others, however many there are."""
    rng = np.random.default_rng(1)
    per_vector = {}
    for clusters in (10, 40):
        base = rng.normal(size=(clusters, 12)) * 5
        rows = [(k, "a", (base[k % clusters] + rng.normal(size=12) * 0.05).tolist()) for k in range(50 * clusters)]
        units = spark.createDataFrame(rows, SCHEMA).mapInArrow(covertree._units, "vec_id long, label string, unit binary")
        members = units.select("label", F.lit(12).alias("dim"), F.lit("").alias("path"), F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("times"), "unit")
        nodes, leaves = covertree._split(members)
        met = covertree._near_leaves(nodes, float(np.sqrt(2 - 2 * 0.93)))
        per_vector[clusters] = met.count() / nodes.where("leaf").count()
        assert leaves.count() == len(rows)
    assert per_vector[40] < 2 * per_vector[10] + 1
