"""Owners of secrets, movement between shards, empty tables, and the pipeline stage by stage on a table whose survivors are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placelake.llm import chat, language, mixing, paragraphs, queries, secrets, sharding, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars int"


def test_owners_of_secrets(spark):
    """A value that three owners hold is copied, one that a single owner holds looks live, however many rows and repositories that owner has."""
    copied, shared, own = "password=copiedExample1", "password=sharedByTwo22", "password=ownedByOneOnly"
    loose = "Zk93" * 6
    rows = [(1, copied, "a", "r1"), (2, copied, "b", "r1"), (3, copied, "c", "r2"), (4, shared, "a", "r1"), (5, shared, "b", "r9"), (6, own, "a", "r1"), (7, own, "a", "r2"), (8, own, "a", "r2"),
            (9, f"{loose} here", "a", "r1"), (10, f"x {loose}", "a", "r3"), (11, "Qq11" * 6, "a", "r1"), (12, "Qq11" * 6, "b", "r1"), (13, copied + " " + own, "a", "r1"), (14, own, None, None)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, owner string, repository string").withColumns({"base": F.lit("x"), "hash": F.lit("y"), "id": F.lit(1)})).collect()}
    assert [(got[k].n_live, got[k].n_copied) for k in (1, 2, 3)] == [(0, 1)] * 3 and [(got[k].n_live, got[k].n_copied) for k in (4, 5)] == [(0, 0)] * 2
    assert [got[k].n_live for k in (6, 7, 8, 14)] == [0] * 4  # no owner counts as one more
    assert got[9].all_spans == "owned:0:24" and got[10].all_spans == "owned:2:26" and got[9].n_live == 1
    assert got[11].all_spans == got[12].all_spans == "" and (got[13].n_assign, got[13].n_copied) == (2, 1)
    one = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows[:13], "doc_id long, text string, owner string, repository string")).collect()}
    assert [one[k].n_live for k in (6, 7, 8)] == [1] * 3 and (one[13].n_live, one[13].n_copied) == (1, 1)
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string, owner string, repository string")).count() == 0


def test_little_moves_between_shards(spark):
    """A shard more takes homes only into itself; with bounded loads most rows stay."""
    d = spark.createDataFrame([(k, "t") for k in range(6000)], "doc_id long, text string")
    before = {r.doc_id: r for r in sharding.ring_shards(d, n_shards=16, slack=0.25).collect()}
    after = {r.doc_id: r for r in sharding.ring_shards(d, n_shards=17, slack=0.25).collect()}
    assert all(after[k].home_shard in (before[k].home_shard, 16) for k in before)
    counts = np.bincount([r.shard for r in before.values()], minlength=16)
    assert counts.max() <= -(-1.25 * 6000 // 16)
    assert sum(before[k].shard != after[k].shard for k in before) / 6000 < 0.25
    even = {r.doc_id: r.shard for r in sharding.ring_shards(d, n_shards=16).collect()}
    more = {r.doc_id: r.shard for r in sharding.ring_shards(d, n_shards=17).collect()}
    assert sum(even[k] != more[k] for k in even) / 6000 < 0.4


def test_empty_tables_and_long_texts(spark):
    turns = spark.createDataFrame([], "pair_id long, side string, turn long, role string, text string")
    assert chat.format_preferences(turns).count() == 0
    assert chat.against_neighbour(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    docs = spark.createDataFrame([], DOC)
    assert language.identify(docs, language.fit(docs)).count() == 0 and mixing.mix(docs, spark.createDataFrame([], "doc_id long, domain string"), {}).rated.count() == 0
    long = "word " * 200_000
    pair = spark.createDataFrame([(1, s, k, "user" if k % 2 == 0 else "assistant", long if k == 3 else s) for s in ("chosen", "rejected") for k in range(4)] * 2, "pair_id long, side string, turn long, role string, text string")
    one = chat.format_preferences(pair).first()
    assert one.n_prompt == 0 and one.n_chosen == 8 and len(one.chosen) > 2_000_000 and one.chosen_mask.count(":") == 4  # repeated rows count each
    whole = spark.createDataFrame([(1, long)], DOC.split(", lang")[0])
    assert sharding.ring_shards(whole).first().size == 1_000_001


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(33)
    say = {"en": [f"the{x}ing" for x in range(300)] + ["the", "and", "with", "house"] * 20, "de": [f"{x}schaft" for x in "abcdefghij"] + [f"ver{x}ung" for x in range(300)] + ["und", "nicht", "schön"] * 20}
    text = lambda lang, n=60: " ".join(rng.choice(say[lang], n))
    item = " ".join(f"quiz{x}" for x in rng.integers(0, 900, 30))
    rows, labels, gone = [], [], {}
    for k in range(300):
        lang = "en" if k % 2 else "de"
        bad = k % 5 == 0
        rows.append((k, text(lang) + (" rotten filth " * 2 if bad else "") + " end", lang))
        if k < 200:
            labels.append((k, 1, int(bad)))
        if bad:
            gone[k] = "mixing"
    for k, (of, stage) in {400: (1, "near_dedup"), 401: (1, "near_dedup"), 402: (3, "near_dedup")}.items():
        rows.append((k, rows[of][1], "en"))
        gone[k] = stage
    rows.append((410, text("en", 40) + " " + item + " " + text("en", 40), "en"))
    rows.append((411, text("en", 40) + " " + " ".join(w if j % 6 else "edit" for j, w in enumerate(item.split())) + " " + text("en", 40), "en"))
    gone |= {410: "decontamination", 411: "decontamination"}
    rows += [(420, None, "en"), (421, "", "en"), (422, "12 34 !!", None), (None, text("en"), "en"), (430, text("de"), None), (431, text("en", 4000), "en")]
    gone |= {420: "language_id", 421: "language_id", 422: "language_id"}
    folder = str(tmp_path_factory.mktemp("corpus"))
    d = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in rows], DOC).withColumns({"rate": F.lit(1.0), "print": F.lit("x"), "p": F.lit(1), "words": F.lit("w"), "shard": F.lit(9), "gone_id": F.lit(3)})
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [k for k, _, _ in rows], gone


def test_pipeline_stage_by_stage(spark, corpus):
    import corpus_pipeline

    folder, ids, gone = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, sorted(ids, key=str)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != "sharding":
            assert docs.columns == columns
        got = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)
        left = [k for k in left if gone.get(k) != name]
        assert got == left, name
    assert corpus_pipeline.run(spark, folder).count() == len(left)


def test_pipeline_of_empty_tables(spark, corpus, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_say_what_they_return():
    assert all(f.__doc__ for f in queries.queries().values()) and len(queries.queries()) == 10
    assert tokens.MARKS and paragraphs.BLOCK + paragraphs.WINDOW - 1 == 50
