"""Small cases for each operator: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; brute force."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placelake.llm import chat, components, covertree, decontaminate, language, mixing, paragraphs, secrets, sharding, simhash, tokens

DOC = "doc_id long, text string, lang string, source string, print string, root string, a int"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, (langs or {}).get(k), f"s{(k or 0) % 3}", "x", "y", 1) for k, t in texts], DOC)


def words(seed, n, size=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, size, n)]


def test_components(spark):
    links = [(1, 2), (2, 3), (7, 8), (8, 9), (9, 7), (20, 3), (5, 5), (None, 1)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7} | {k: 100 for k in range(100, 160)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_keys_meet():
    """Any two fingerprints at three bits or fewer share a key: one's own index is among the other's several."""
    errors, bits = simhash.golay_tables()
    assert len(set(errors.tolist())) == 2048
    rng = np.random.default_rng(1)
    word = rng.integers(0, 1 << 23, 500).astype(np.uint32)
    near = simhash.near_codewords(word, errors, bits)
    for k in range(23):
        other = simhash.near_codewords(word ^ np.uint32(1 << k), errors, bits)[:, :1]
        assert (near == other).any(axis=1).all()


def test_simhash(spark):
    base = words(3, 300)
    texts = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:-1], "zz"])), (4, None), (5, ""), (6, " \n"), (7, "one"), (8, "ONE"), (9, " ".join(words(9, 5000))), (9, " ".join(words(9, 5000)))]
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    prints = np.array([r["print"] for r in got], dtype=np.int64).view(np.uint64)
    ids = [r.doc_id for r in got]
    for k, r in enumerate(got):
        reach, todo = {k}, [k]
        while todo:
            x = todo.pop()
            new = {int(j) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[x]) <= 3)} - reach
            reach |= new
            todo += new
        assert r.component_id == min(ids[j] for j in reach)
    assert {r.doc_id: r["print"] for r in got if r.doc_id in (4, 5, 6)} == {4: 0, 5: 0, 6: 0}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, texts)).collect()}
    assert {1, 4, 7, 9} <= kept and not kept & {2, 5, 6, 8}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_links_at_random(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for s in seeds for n in (0, 1, 2, 3, 3, 4)]
    prints = np.array(near, dtype=np.uint64)
    rows = [(k, int(p)) for k, p in enumerate(prints.view(np.int64))]
    got = {r["print"]: r.component_id for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, print long")).collect()}
    for k, (_, p) in enumerate(rows):
        reach, todo = {k}, [k]
        while todo:
            new = {int(j) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[todo.pop()]) <= 3)} - reach
            reach |= new
            todo += new
        assert got[p] == min(reach)


def test_sharding(spark):
    rows = [(k % 900 if k else None, "x" * (k % 7) if k % 11 else None) for k in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.ring_shards(d, n_shards=16, per_shard=8).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 1000 and {len(x) for x in by.values()} <= {62, 63} and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.ring_shards(d.limit(0)).count() == 0
    counts, owners = [5, 0, 9], [0, 1, 0]
    assert sharding.spill_clockwise(counts, owners, [7, 7]) == [(0, 0, 5, 0), (2, 0, 2, 0), (2, 2, 9, 1)]
    assert sharding.capacities(10, 4, 0.25) == [4] * 4


def test_language(spark):
    de, en = "der die und ich nicht schön gehen haben werden zwischen", "the and with have going because there which would should"
    texts = [(k, " ".join(np.random.default_rng(k).permutation((de if k % 2 else en).split()))) for k in range(60)]
    d = docs(spark, texts, {k: "de" if k % 2 else "en" for k, _ in texts})
    model = language.fit(d)
    odd = [(100, None), (101, ""), (102, "123 !!"), (103, de + " " + en), (104, "the " * 50_000), (105, "der und\nich")]
    got = {r.doc_id: r for r in language.identify(docs(spark, odd + texts), model).collect()}
    assert all(got[k].lang_pred == ("de" if k % 2 else "en") for k, _ in texts)
    assert [got[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0
    assert got[103].languages.count(":") == 2 and got[104].lang_pred == "en" and got[105].lang_pred == "de"
    assert language.keep_identified(docs(spark, odd), model).count() == 3
    empty = language.fit(docs(spark, []))
    assert [r.lang_pred for r in language.identify(docs(spark, odd[-1:]), empty).collect()] == ["und"]


def test_secrets(spark):
    key = "AKIA" + "Q7" * 10
    texts = [(1, f"password = 'hunter2hunter2' {key}"), (2, None), (3, ""), (4, "token: short"), (5, "\u0001é API_KEY:\"" + "ab12" * 10 + '"'), (6, "deadbeef" * 5), (7, "password=api_key:abcdefghij"), (8, "Zk9" * 12), (9, "secret=" + "a" * 100_000), (1, f"password = 'hunter2hunter2' {key}")]
    got = secrets.scan(docs(spark, texts).withColumn("owner", F.col("source")).withColumn("repository", F.lit("r"))).collect()
    assert len(got) == len(texts)
    assign = re.compile(secrets.ASSIGN, re.A)
    want = {}
    for k, t in texts:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8] + [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 16] + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 32]
        want[k] = ",".join(f"{secrets.KINDS[n]}:{a}:{b}" for a, n, b in sorted(found))
    assert all(r.base == want[r.doc_id] for r in got)
    rows = {r.doc_id: r for r in got}
    assert rows[8].all_spans == "owned:0:36" and rows[8].base == "" and rows[2].n_assign == 0


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = [(5, "Hello, World. it's 42!"), (1, None), (2, ""), (3, "ÉCOLE Σίσυφος. a\x1cb <|endoftext|> İx."), (4, "long. " * 20_000), (4, "tie"), (None, "no id"), (9, "é ́x ΑΣ.")]
    out = tokens.write_tokens(docs(spark, texts), path)
    got = tokens.read_tokens(spark, out).collect()
    t, start = Tokenizer.from_file(path), 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    own = {(r.doc_id, r.n_tokens): r.ids_crc32 for r in got}
    for k, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert own[k, len(ids)] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)][1:] == [1, 2, 3, 4, 4, 5, 9]
    whole = tokens.read_tokens(spark, tokens.write_tokens(docs(spark, texts), path, by_word=False))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, got), key=str)
    assert tokens.read_tokens(spark, tokens.write_tokens(docs(spark, []), path)).count() == 0


def test_decontamination(spark):
    item = words(1, 30, 5000)
    edited = [w if k % 5 else f"e{k}" for k, w in enumerate(item)]
    clean = words(2, 3000, 5000)
    texts = [(1, " ".join([*clean[:50], *item, *clean[50:90]])), (2, " ".join([*clean[90:140], *edited])), (3, " ".join(clean)), (4, None), (5, ""), (6, " ".join(item).upper()), (6, " ".join(item))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "..."), (10, "w1")], "item_id long, text string").withColumn("words", F.lit(1))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, texts), bench).where("item_id = 7").collect()}
    assert sorted(k for k, _ in got) == [1, 2, 6] and got[1, 7].score == 1.0 and 0.5 <= got[2, 7].score < 1
    assert (got[1, 7].start_word, got[1, 7].end_word) == (50, 80)
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0 == decontaminate.contaminated(docs(spark, []), bench).count()


def test_decontamination_of_frequent_copies(spark):
    """Copies of an edited item count like any other passage, however many there are and whatever else holds the item."""
    item = words(1, 30, 5000)
    edited = [w if k % 5 else f"e{k}" for k, w in enumerate(item)]
    texts = [(0, " ".join(item)), *((k, " ".join(edited)) for k in range(1, 41))]
    got = decontaminate.contaminated(docs(spark, texts), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(41))


def test_bound_of_alignment_holds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(-2, 6, rng.integers(1, 15))
        assert decontaminate.align(a, [b])[0][0] / (2 * len(a)) <= decontaminate.reachable(a, b)


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, low, high = decontaminate.align(a, [b])
        assert score[0] == h.max() and 0 <= low[0] <= high[0] <= len(b)


def test_cover_tree(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 8))
    rows = [(k, int(k % 3), (base[k % 25] + rng.normal(size=8) * 0.15).tolist()) for k in range(200)]
    rows += [(500, 1, rows[0][2]), (501, 0, rows[0][2]), (502, 0, rows[0][2]), (503, None, rows[0][2]), (504, 0, None), (505, 0, [0.0] * 8), (506, 0, [float("nan")] * 8), (507, 0, [None] * 8), (508, 0, [1.0]), (509, 0, (np.array(rows[0][2]) * 1e30).tolist())]
    e = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("rep", F.lit(1))
    got = {r.vec_id: r for r in covertree.near_vectors(e).collect()}
    good = [(i, l, np.array(v) / np.linalg.norm(v)) for i, l, v in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    near = {i: [j for j, m, w in good if j != i and m == l and len(w) == len(v) and v @ w >= 0.93] for i, l, v in good}
    for i, _, _ in rows:
        reach, todo = {i}, [i]
        while todo:
            new = set(near.get(todo.pop(), [])) - reach
            reach |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near.get(i, [])), min(reach), min(reach) == i)
    assert covertree.near_vectors(e.limit(0)).count() == 0


def test_mixing(spark):
    texts = [(k, " ".join([*words(k, 40), *(["awful", "dreadful"] if k % 4 == 0 else ["lovely"])])) for k in range(200)] + [(500, None), (501, ""), (502, "awful dreadful"), (502, "awful dreadful")]
    labels = spark.createDataFrame([(k, "bad" if k % 4 == 0 else "fine") for k in range(0, 160)] + [(999, "fine"), (None, "bad"), (3, None)], "doc_id long, domain string")
    rated, names = mixing.mix(docs(spark, texts), labels, {"fine": 1.0})
    got = {r.doc_id: r for r in rated.collect()}
    assert names == ["bad", "fine"] and len(got) == 203
    assert all((got[k].rate < 0.5) == (k % 4 == 0) for k in range(200)) and got[502].rate < 0.5 and got[500].tokens == 0
    total = sum(r.tokens for r in rated.collect())
    assert abs(sum(r.tokens * r.p[1] * r.rate for r in rated.collect()) / total - 1) < 0.02
    plain, none = mixing.mix(docs(spark, texts), labels.limit(0), {})
    assert none == [] and {r.rate for r in plain.collect()} == {1.0}
    assert mixing.drop_unwanted(docs(spark, texts), labels, {"fine": 1.0}).count() == 152


def test_paragraphs(spark):
    s = lambda seed, n: " ".join(words(seed, n, 100_000)).capitalize() + "."
    passage = " ".join(s(50 + k, 12) for k in range(5))
    near = passage.replace(passage.split()[30], "changed", 1)
    texts = [(1, s(1, 9) + "\n" + s(2, 30) + " " + passage + " " + s(3, 20)), (2, "x y z " + s(4, 15) + " " + passage + "\n" + s(5, 9)), (3, " ".join(s(100 + k, 14) for k in range(10))), (4, None), (5, ""), (6, near), (7, "."), (8, "a " * 30_000)]
    got = paragraphs.repeated_passages(docs(spark, texts)).collect()
    assert {r.doc_id for r in got} == {1, 2, 6} and {r.doc_id for r in got if r.kept} == {1}
    assert all(1 in r.first_doc_ids for r in got)
    assert paragraphs.repeated_passages(docs(spark, [])).count() == 0
    bands, rows = paragraphs.tune_bands(0.8, 0.98)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.98


def test_mixing_counts_distinct_texts(spark):
    """Texts that share a long word are not copies; copies, exact or near, count once."""
    texts = {k: ["dreadful", *words(k, 40)] for k in range(20)}
    texts |= {100: texts[3], 101: [*texts[3][:20], "changed", *texts[3][21:]], 102: [], 103: ["dreadful"]}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, ws array<string>")
    got = {r.k_id: r.kin for r in mixing.near_copies(rows).collect()}
    assert got == {k: 3 if k in (100, 101) else k for k in texts}
    model = mixing.fit(docs(spark, [(k, " ".join(w)) for k, w in texts.items() if k < 102]), spark.createDataFrame([(k, "fine" if k % 4 else "bad") for k in range(20)], "doc_id long, domain string"))
    assert np.allclose(model.base, np.log([0.25, 0.75]))  # each of the 20 counts


def test_passages_without_sentences(spark):
    """Verse and long lines: no sentence of eight words ends there, so that a whole text is one paragraph."""
    own = lambda seed, n: words(seed, n, 100_000)
    verse = lambda ws: "\n".join(" ".join(ws[k : k + 5]) for k in range(0, len(ws), 5))
    p, q = own(1, 60), own(2, 50)
    texts = [(1, verse(own(3, 200) + p + own(4, 100))), (2, verse(own(5, 33) + p + own(6, 170))), (3, " ".join(own(7, 300) + q)), (4, " ".join(q + own(8, 90))), (5, verse(own(9, 300))), (6, "a " * 300), (7, None)]
    got = {r.doc_id: r for r in paragraphs.repeated_passages(docs(spark, texts)).collect()}
    assert {k: (r.start_word, r.end_word, r.removed_words, r.kept, r.first_doc_ids) for k, r in got.items()} == {
        1: (200, 260, 0, True, [1]), 2: (33, 93, 60, False, [1]), 3: (300, 350, 0, True, [3]), 4: (0, 50, 50, False, [3]),
    }


def test_blocks_are_picked_alike_anywhere():
    rng = np.random.default_rng(5)
    for k in range(50):
        run = " ".join(f"w{x}" for x in rng.integers(0, 3 if k % 2 else 1000, 50))
        sides = [" ".join(f"v{x}" for x in rng.integers(0, 1000, n)) for n in rng.integers(0, 90, 4)]
        _, doc, content = paragraphs.blocks(paragraphs.Cut(pa.array([f"{sides[0]} {run} {sides[1]}", f"{sides[2]} {run} {sides[3]}"])))
        assert set(content[doc == 0]) & set(content[doc == 1])


def test_preferences(spark):
    rows = [(1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"), (1, "rejected", None, "user", "late"),
            (2, "chosen", 0, None, None), (2, "rejected", 0, None, None), (3, "chosen", 0, "user", "a"), (None, "chosen", 0, "user", "a"), (4, "other", 0, "user", "a")]
    t = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("a", F.lit(1))
    got = {r.pair_id: r for r in chat.format_preferences(t).collect()}
    assert sorted(got) == [1, 2, 3]
    one = got[1]
    assert (one.n_prompt, one.prompt, one.chosen) == (1, "<|user|>\nhi<|end|>\n", "<|assistant|>\nyes<|end|>\n")
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen[a:b] == "yes<|end|>" and one.rejected_mask.count(":") == 1 and one.n_rejected == 2
    assert got[2].n_prompt == 1 and got[2].chosen == got[2].rejected == "" and got[3].n_prompt == 0 and got[3].rejected == ""
    c = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "A"), (1, 0, "user", "p"), (1, 1, "assistant", "B")], "conv_id long, turn long, role string, text string")
    pair = {r.pair_id: r for r in chat.format_preferences(chat.against_neighbour(c)).collect()}
    assert "B" in pair[0].rejected and "A" in pair[0].chosen and pair[0].n_prompt == 1


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0.5 * d.count() < len(ids) <= d.count()
