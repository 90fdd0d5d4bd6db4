"""Paragraph dedup against brute-force Jaccard, with equal rows and rows without an id."""

import pickle

import numpy as np
import pyarrow as pa

from placelake.llm import paragraphs

DOC = "doc_id long, text string"


def sentence(rng, n):
    return " ".join(f"v{x}" for x in rng.integers(0, 100_000, n)).capitalize() + "."


def brute_force(texts, least=0.8):
    """Clusters of the texts' paragraphs, all pairs compared: sets of (text number, paragraph number)."""
    cut = paragraphs.Cut(pa.array(texts))
    high = np.append(cut.first[1:], len(cut.shingle))
    sets = [frozenset(cut.shingle[a:b].tolist()) for a, b in zip(cut.first, high, strict=True)]
    name = list(zip(cut.doc.tolist(), (np.arange(len(cut.doc)) - np.searchsorted(cut.doc, cut.doc)).tolist(), strict=True))
    left, out = set(range(len(sets))), []
    while left:
        own, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            own.add(x)
            near = {y for y in left if len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y])}
            left -= near
            todo += near
        out.append({name[k] for k in own})
    return [c for c in out if len(c) > 1]


def test_clusters_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(12)
    base = [sentence(rng, int(n)) for n in rng.integers(9, 60, 30)]
    texts = []
    for _ in range(60):
        parts = []
        for k in rng.choice(30, 5, replace=False):
            w = base[k].split()
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w) - 1))] = f"edit{rng.integers(0, 9)}"
            parts.append(" ".join(w))
        texts.append(" ".join(parts))
    got = {}
    for r in paragraphs.clustered(spark.createDataFrame(list(enumerate(texts)), DOC), recall=0.999999).collect():
        got.setdefault(r.cluster, set()).add((r.doc_id, r.number))
    want = brute_force(texts)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_equal_rows_and_rows_without_an_id(spark):
    rng = np.random.default_rng(2)
    text, other = " ".join(sentence(rng, 15) for _ in range(4)), " ".join(sentence(rng, 15) for _ in range(4))
    rows = [(5, text), (5, text), (5, text), (None, text), (None, other), (None, other), (7, sentence(rng, 60)), (8, None), (8, ""), (None, None)]
    got = [(r.doc_id, r.copy, r.removed_words, r.kept) for r in paragraphs.repeated_passages(spark.createDataFrame(rows, DOC)).collect()]
    assert sorted(got, key=str) == sorted([(5, 0, 0, True), (5, 1, 60, False), (5, 2, 60, False), (None, 0, 60, False), (None, 0, 0, True), (None, 1, 60, False)], key=str)
    # a verbatim run within rows that are equal, cut by no sentence
    run = " ".join(f"r{x}" for x in range(80))
    got = [(r.doc_id, r.copy, r.kept) for r in paragraphs.repeated_passages(spark.createDataFrame([(1, run), (1, run)], DOC)).collect()]
    assert sorted(got) == [(1, 0, True), (1, 1, False)]


def test_columns_of_clashing_names(spark):
    run = " ".join(f"r{x}" for x in range(80))
    d = spark.createDataFrame([(1, run, 1, 2, "x"), (2, run, 1, 2, "x")], DOC + ", content int, row_id int, cluster string")
    assert {r.doc_id: r.kept for r in paragraphs.repeated_passages(d).collect()} == {1: True, 2: False}


def test_words_in_other_cases_and_marks_are_equal():
    cut = paragraphs.Cut(pa.array(["Straße, ÉCOLE! snake_case 42.", "straße école snake_case (42)", None, "", "…"]), words_only=True)
    n = np.diff(cut.starts)
    assert n.tolist() == [4, 4, 0, 0, 0] and (cut.hashes[:4] == cut.hashes[4:]).all()


def test_filters_stay_out_of_the_driver(spark, monkeypatch):
    def taken(*_):
        raise AssertionError("the driver takes a table")

    content = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 200_000)
    rows = spark.createDataFrame(pa.table({"content": content}).slice(0, 100_000))
    monkeypatch.setattr(type(rows), "toPandas", taken)
    found = paragraphs._filter_bits(rows)
    assert len(pickle.dumps(found)) < 10_000
    held = paragraphs._held(pickle.loads(pickle.dumps(found)), content.view(np.uint64))
    assert held[:100_000].all() and held[100_000:].mean() < 0.1
    assert not paragraphs._held(paragraphs._filter_bits(rows.limit(0)), content.view(np.uint64)).any()
