"""Decontamination loses no pair that an alignment of all documents with all items finds."""

import numpy as np
import pyarrow as pa

from placelake.llm import decontaminate

DOC = "doc_id long, text string"


def edited(rng, item, rate):
    out = []
    for w in item:
        kind = rng.random()
        if kind < rate / 3:  # lost
            continue
        out.append(f"e{rng.integers(0, 50)}" if kind < 2 * rate / 3 else w)
        if kind > 1 - rate / 3:
            out.append(f"i{rng.integers(0, 50)}")
    return out


def all_pairs(texts, items, least=0.5):
    coded = decontaminate.code_items(items, least)
    out = {}
    for d, t in texts:
        known, _ = decontaminate._known(coded, pa.array([t], pa.large_string()))
        for i, w in zip(coded.ids, coded.words, strict=True):
            if len(known):
                score = decontaminate.align(w, [known])[0][0] / (2 * len(w))
                if score >= least:
                    out[d, i] = round(float(score), 9)
    return out


def test_no_pair_is_lost_at_any_edit_rate(spark):
    rng = np.random.default_rng(21)
    common = [f"c{k}" for k in range(12)]
    word = lambda: common[rng.integers(0, 12)] if rng.random() < 0.5 else f"w{rng.integers(0, 3000)}"
    items = [(100 + k, " ".join(word() for _ in range(n))) for k, n in enumerate([3, 4, 5, 6, 8, 12, 20, 30, 30, 45, 60, 80])]
    texts, rate_of = [], {}
    for k in range(240):
        i = int(rng.integers(0, len(items)))
        rate = (k % 8) / 8
        own = edited(rng, items[i][1].split(), rate)
        texts.append((k, " ".join([word() for _ in range(rng.integers(0, 60))] + own + [word() for _ in range(rng.integers(0, 60))])))
        rate_of[k] = rate
    w = items[7][1].split()
    texts += [(900, " ".join(x for y in w for x in (y, "zz"))), (901, " ".join(y if k % 3 else "zz" for k, y in enumerate(w))), (902, " ".join(w[::2])), (903, None), (904, "...")]
    want = all_pairs(texts, items)
    assert {(900, 107), (901, 107)} <= set(want) and len(want) > 120
    got = decontaminate.contaminated(spark.createDataFrame(texts, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.score, 9) for r in got} == want  # recall 1 at every edit rate
    assert len({rate_of[d] for d, _ in want if d < 900}) >= 5


def test_short_items_ties_and_repeated_rows(spark):
    texts = [(1, "Alpha beta"), (1, "Alpha beta"), (2, "beta"), (3, "gamma delta alpha, beta! end"), (None, "solo"), (4, "solo solo"), (5, "x " * 40_000 + "alpha beta")]
    items = [(10, "alpha beta"), (11, "solo"), (12, "Alpha Beta"), (None, "gamma delta"), (13, ""), (14, None)]
    got = {(r.doc_id, r.item_id): (r.score, r.start_word, r.end_word) for r in decontaminate.contaminated(spark.createDataFrame(texts, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    both = {(1, 0, 2), (3, 2, 4), (5, 40_000, 40_002)}
    want = {(d, i): (1.0, a, b) for d, a, b in both for i in (10, 12)} | {(None, 11): (1.0, 0, 1), (4, 11): (1.0, 1, 2), (3, None): (1.0, 0, 2)}
    assert got == want


def test_templated_items(spark):
    """Items that share nearly all their words: a passage of one is a passage of each that it aligns with."""
    items = [(k, f"what is the answer to question number n{k} of the long list") for k in range(60)]
    texts = [(k, f"so: {t}, it said") for k, t in items[:5]]
    got = decontaminate.contaminated(spark.createDataFrame(texts, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == 300 and sum(r.score == 1.0 for r in got) == 5
