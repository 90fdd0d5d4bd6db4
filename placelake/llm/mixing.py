"""Mixing sources to target weights by soft membership; DataFrame operations only.

A Bernoulli naive-Bayes classifier over the most telling words of labelled documents, and over a few marks of how a text is
written, gives every document a posterior over domains; a temperature, fitted on labelled documents held out, calibrates it.
Projected gradient descent then finds nonnegative rates, one for each document, whose expected tokens by domain (tokens times
rate times posterior) match targets in least squares. A step moves a document's rate by its posterior times the domains'
residuals, which are a handful of sums over the corpus, and projects it on 0 and up; rates start at 1.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake.llm.common import checkpoint

#: Labelled rows that the classifier is fitted on at most (about: drawn by hash), and words that it looks at at most.
TRAIN_ROWS, WORDS = 8_000, 2_000
#: What a word must tell at least: half its G statistic, and its rate in some domain as a multiple of its rate overall. So
#: words that fell to one domain by chance are left out, and common ones that only tell long texts from short ones.
GAIN, LIFT = 15.0, 2.5
#: Near copies among labelled documents: words of a shingle, how many of a text's least hashes stand for it, seeds under which one
#: of them brings texts together, and the share that they must have in common.
SHINGLE, SKETCH, MINHASHES, ALIKE = 5, 256, 4, 0.5
#: One labelled row in so many is held out of the fit, for the temperature; and the temperatures tried.
HELD_OUT = 5
TEMPERATURES = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0]
#: What separates words: white space and ASCII punctuation.
SPACE = r"[\s!-/:-@\[-`{-~]+"
#: Rounds between two checkpoints of the rates.
STRIDE = 6


@dataclass
class Classifier:
    domains: list[str]
    base: list[float]
    weights: list[tuple]  # (hash of a word, weight for each domain)
    temperature: float = 1.0


@dataclass
class Mixed:
    """Rated documents and the domains in the order of p, which it unpacks to; and the residual left, as a share of all tokens aimed at."""

    rated: DataFrame
    domains: list[str]
    residual: float

    def __iter__(self) -> Iterator:
        return iter((self.rated, self.domains))


def words_of(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE)


def n_words(words: Column) -> Column:
    """Words of a split text; empty pieces are at its ends alone."""
    return (F.size(words) - (F.element_at(words, 1) == "").cast("int") - ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")).cast("long")


def features(text: Column, words: Column) -> Column:
    """A text's words as distinct hashes, and marks, hashed too: how much stands between its words, and how seldom they repeat.

    Among strings, distinct elements are found by comparing all pairs; so words are hashed first.
    """
    hashes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))
    n = F.greatest(n_words(words), F.lit(1))
    between = F.char_length(F.coalesce(text, F.lit(""))) - F.char_length(F.array_join(words, ""))
    marks = [F.concat(F.lit("\u0001between "), F.least(F.floor(2 * between / n), F.lit(12)).cast("string")), F.concat(F.lit("\u0001distinct "), F.floor(8 * F.size(hashes) / n).cast("string"), F.lit(" of "), F.floor(F.log2(n)).cast("string"))]
    return F.when(n_words(words) > 0, F.concat(hashes, F.array(*(F.xxhash64(m) for m in marks)))).otherwise(hashes)


def near_copies(rows: DataFrame, within: str | None = None) -> DataFrame:
    """(k_id, kin) for each doc_id of rows (doc_id, ws): the smallest doc_id that it is found to be a near copy of, or its own.

    A text's SKETCH least shingle hashes stand for it. One of them brings a text together with the smallest doc_id (of equal
    `within`, if given) that has the same one; those that share ALIKE of their hashes with it are near copies of it. Kin of
    kin are followed three times. Texts without a word are not alike. Rows are labelled ones, TRAIN_ROWS about, so that
    sketches and heads are broadcast.
    """
    hashed = rows.select("doc_id", F.col(within).alias("w") if within else F.lit("").alias("w"), F.transform(F.filter("ws", lambda w: w != ""), lambda w: F.xxhash64(w)).alias("hs"))
    each = F.transform(F.sequence(F.lit(1), F.size("hs") - (SHINGLE - 1)), lambda k: F.xxhash64(*(F.element_at("hs", k + j) for j in range(SHINGLE))))
    shingles = F.when(F.size("hs") >= SHINGLE, each).when(F.size("hs") > 0, F.array(F.xxhash64("hs"))).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = checkpoint(hashed.select("doc_id", "w", F.slice(F.array_sort(F.array_distinct(shingles)), 1, SKETCH).alias("s")))
    seeded = lambda j: F.array_min(F.transform("s", lambda x: F.xxhash64(x, F.lit(j))))
    least = F.array(*map(seeded, range(MINHASHES)))
    keys = rows.select("doc_id", "w", F.col("s").alias("a"), F.posexplode(least).alias("seed", "key")).where("key is not null")
    heads = F.broadcast(keys.groupBy("w", "seed", "key").agg(F.min("doc_id").alias("head")))
    of = F.broadcast(rows.select(F.col("doc_id").alias("b_id"), F.col("s").alias("b")))
    pairs = keys.join(heads, ["w", "seed", "key"]).where("doc_id != head").join(of, F.col("head") == F.col("b_id"))
    both = F.size(F.array_intersect("a", "b"))
    alike = checkpoint(pairs.where(both >= ALIKE * (F.size("a") + F.size("b") - both)).groupBy("doc_id").agg(F.min("head").alias("head")))
    kin = rows.select(F.col("doc_id").alias("k_id"), F.col("doc_id").alias("kin"))
    for k in range(4):
        up = F.broadcast(alike.select(F.col("doc_id").alias(f"u{k}"), F.col("head").alias("up")))
        kin = kin.join(up, F.col("kin") == F.col(f"u{k}"), "left").select("k_id", F.coalesce("up", "kin").alias("kin"))
    return kin


def _drawn(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(domain, held, hs) of labelled documents, `most_rows` about; of near copies in a domain the first stands for all."""
    told = labels.where("doc_id is not null and domain is not null").select(F.col("doc_id").cast("long").alias("l_id"), F.col("domain").cast("string").alias("domain")).dropDuplicates(["l_id"])
    total = told.count()
    share = 1 << 20 if total <= most_rows else max(1, (most_rows << 20) // total)
    drawn = checkpoint(told.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 20)) < share))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("l_id"))  # most_rows rows, about
    rows = checkpoint(rows.select("domain", "l_id", F.monotonically_increasing_id().alias("doc_id"), "text", words_of(F.col("text")).alias("ws")))
    kin = near_copies(rows, "domain").where("k_id = kin").select("k_id")
    rows = rows.join(F.broadcast(kin), F.col("doc_id") == F.col("k_id"), "left_semi")
    return checkpoint(rows.select("domain", "l_id", (F.pmod(F.xxhash64("l_id"), F.lit(HELD_OUT)) == 0).alias("held"), features(F.col("text"), F.col("ws")).alias("hs")))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = TRAIN_ROWS, most_words: int = WORDS) -> Classifier:
    """Learn from docs (doc_id, text) and labels (doc_id, domain). Rows with a null in either label column teach nothing.

    Near copies in a domain count once; so do equal rows. The words of one row in HELD_OUT aren't counted: these rows choose
    the temperature that makes their domains likeliest. The driver gets counts by word and domain for `most_words` words,
    and the number of documents of each domain.
    """
    rows = _drawn(docs, labels, most_rows)
    taught = rows.where("not held")
    met = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count(F.when(~F.col("held"), 1)).alias("taught")).collect()
    shares, n_docs = {r.domain: r.n for r in met}, {r.domain: r.taught for r in met}
    domains = sorted(n_docs)
    if not domains:
        return Classifier([], [], [])
    k, all_docs = range(len(domains)), max(1, sum(n_docs.values()))
    # what stands beside explode() in one select is worked out for each word; so it is checkpointed before
    words = taught.select("domain", F.explode("hs").alias("w"))
    by_word = words.groupBy("w").agg(*(F.count(F.when(F.col("domain") == d, 1)).alias(f"n{i}") for i, d in enumerate(domains)))
    n_all = sum((F.col(f"n{i}") for i in k), F.lit(0))
    rate = [(F.col(f"n{i}") + 0.5) / (n_docs[d] + 1.0) for i, d in enumerate(domains)]
    gain = sum((F.col(f"n{i}") * F.log(rate[i] * all_docs / n_all) for i in k), F.lit(0.0))  # information on the domain from words that occur
    lift = F.greatest(*(rate[i] * all_docs / n_all for i in k), F.lit(0.0))
    top = by_word.withColumn("gain", gain).where((F.col("gain") >= GAIN) & (lift >= LIFT)).orderBy(F.desc("gain"), "w").limit(most_words).collect()
    base, weights = [log(shares[d] / sum(shares.values())) for d in domains], []
    for r in top:
        row = []
        for i, d in enumerate(domains):
            p = (r[f"n{i}"] + 0.5) / (n_docs[d] + 1.0)
            row.append(log(p) - log(1 - p))
            base[i] += log(1 - p)
        weights.append((r.w, *row))
    model = Classifier(domains, base, weights)
    model.temperature = _temperature(rows.where("held"), model)
    return model


def _logs(rows: DataFrame, model: Classifier, keys: list[str]) -> DataFrame:
    """keys and `l`, the log of each domain's share up to a common term, for rows (id, keys, hs) with an id of their own."""
    k = range(len(model.domains))
    table = F.broadcast(rows.sparkSession.createDataFrame(model.weights, "h long, " + ", ".join(f"w{i} double" for i in k)))  # WORDS rows at most
    found = rows.select("id", *keys, F.explode("hs").alias("w")).join(table, F.col("w") == F.col("h"), "left")
    sums = found.groupBy("id", *keys).agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in k))
    return sums.select(*keys, F.array(*(F.coalesce(f"s{i}", F.lit(0.0)) + model.base[i] for i in k)).alias("l"))


def softmax(logs: Column, temperature: float) -> Column:
    e = F.transform(logs, lambda x: F.exp((x - F.array_max(logs)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _temperature(held: DataFrame, model: Classifier) -> float:
    """The one of TEMPERATURES under which the domains of held-out rows are likeliest; 1 without any."""
    names = F.array(*map(F.lit, model.domains))
    logs = checkpoint(_logs(held.select(F.col("l_id").alias("id"), F.array_position(names, F.col("domain")).cast("int").alias("own"), "hs").where("own > 0"), model, ["own"]))
    likely = [F.sum(F.log(F.greatest(F.element_at(softmax(F.col("l"), t), F.col("own")), F.lit(1e-12)))) for t in TEMPERATURES]
    found = logs.agg(*likely).first()
    best = max(zip(found, TEMPERATURES, strict=True), key=lambda x: (float("-inf") if x[0] is None else x[0], -abs(x[1] - 1.0)))
    return best[1]


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, tokens, p (array of doubles in the order of model.domains), one row per row of docs (doc_id, text), read whole.

    tokens counts words, as the classifier splits them; null and empty texts have none, and the posterior of a text without words.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("id"), "text", words_of(F.col("text")).alias("ws"))
    rows = rows.select("doc_id", "id", n_words(F.col("ws")).alias("tokens"), features(F.col("text"), F.col("ws")).alias("hs"))
    return _logs(rows, model, ["doc_id", "tokens"]).select("doc_id", "tokens", softmax(F.col("l"), model.temperature).alias("p"))


def inverse(matrix: list[list[float]]) -> list[list[float]]:
    """Of a small symmetric matrix with no negative eigenvalue; a trifle on the diagonal stands for what it lacks in rank."""
    n = len(matrix)
    trifle = max(1e-9 * sum(matrix[i][i] for i in range(n)), 1e-12)
    rows = [[matrix[i][j] + (trifle if i == j else 0.0) for j in range(n)] + [float(i == j) for j in range(n)] for i in range(n)]
    for i in range(n):
        top = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[top] = rows[top], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i], strict=True)]
    return [row[n:] for row in rows]


def solve_rates(members: DataFrame, targets: list[float], rounds: int = 40, tolerance: float = 1e-3) -> tuple[DataFrame, float]:
    """Add `rate` to members (doc_id, tokens, p): nonnegative rates whose expected tokens by domain fit `targets` (tokens);
    and the residual: what the domains are off, added up, as a share of all that is aimed at.

    Least squares by projected gradient steps from rate 1, with momentum. Residuals are measured in the norm of the inverse
    of the documents' Gram matrix, the sum of tokens times posterior times posterior: in it all eigenvalues are 1, whatever
    domains have in common, so that steps of length 1 never overshoot. Where rates exist that fit, the norm decides nothing.
    A document's rate moves from the point ahead of it, against its posterior times the residuals there, and is projected
    on 0 and up in every step; rates are checkpointed every STRIDE rounds and worked out again from there. Each round is one
    aggregation. Ends when the residual is `tolerance`, when it has lost less than a hundredth in eight rounds (targets
    that no rates reach), or after `rounds`.
    """
    k = range(len(targets))
    flat = members.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)})
    gram = members.agg(*(F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]) for i in k for j in k)).first()
    unit = inverse([[gram[len(targets) * i + j] or 0.0 for j in k] for i in k])
    sums = [F.sum(F.col("tokens") * F.col("p")[i] * F.col(c)).alias(f"{c}{i}") for c in ("rate", "ahead") for i in k]
    got, total, off = flat.agg(*sums).first(), max(1.0, sum(targets)), []
    for round_ in range(rounds + 1):
        off.append(sum(abs((got[f"rate{i}"] or 0.0) - targets[i]) for i in k) / total)
        if off[-1] <= tolerance or len(off) > 8 and off[-1] > 0.99 * off[-9] or round_ == rounds:
            break
        slope = [sum(unit[i][j] * ((got[f"ahead{j}"] or 0.0) - targets[j]) for j in k) for i in k]
        flat = flat.withColumn("new", F.greatest(F.lit(0.0), F.col("ahead") - sum((F.col("p")[i] * slope[i] for i in k), F.lit(0.0))))
        flat = flat.withColumn("ahead", F.col("new") + (F.col("new") - F.col("rate")) * (round_ / (round_ + 3.0))).withColumn("rate", F.col("new")).drop("new")
        if round_ % STRIDE == STRIDE - 1:
            flat = checkpoint(flat)
        got = flat.agg(*sums).first()
    return flat.drop("ahead"), off[-1]


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | Collection[str], total: float = 1.0) -> Mixed:
    """doc_id, tokens, p, rate, copies for each row of docs (doc_id, text), the domains in the order of p, and the residual.

    labels: doc_id, domain. weights: the share of expected tokens that each domain shall have, out of `total` times the
    corpus, others 0; or the domains that shall keep `total` times the expected tokens that they have, others none.
    copies is the rate rounded up or down by a hash of doc_id, so that its expectation is the rate. Without any usable
    label every rate is 1.
    """
    model = fit(docs, labels)
    if not model.domains:
        size = n_words(words_of(F.col("text")))
        return Mixed(docs.select(F.col("doc_id").cast("long"), size.alias("tokens"), F.expr("cast(array() as array<double>)").alias("p"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies")), [], 0.0)
    members = checkpoint(posteriors(docs, model))
    if isinstance(weights, dict):
        tokens = float(members.agg(F.sum("tokens")).first()[0] or 0)
        targets = [total * tokens * weights.get(d, 0.0) for d in model.domains]
    else:
        own = members.agg(*(F.sum(F.col("tokens") * F.col("p")[i]) for i in range(len(model.domains)))).first()
        targets = [total * (x or 0.0) if d in weights else 0.0 for x, d in zip(own, model.domains, strict=True)]
    rated, residual = solve_rates(members, targets)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    return Mixed(rated.withColumn("copies", F.floor(F.col("rate") + draw).cast("long")), model.domains, residual)


def drop_unwanted(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | Collection[str], least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, but those whose rate is under `least` and that rather belong to domains without a
    target than to the others; a doc_id goes as a whole, rows without one stay."""
    rated, names = mix(docs, labels, weights)
    wanted = [i for i, d in enumerate(names) if (weights.get(d, 0.0) > 0 if isinstance(weights, dict) else d in weights)]
    own = sum((F.col("p")[i] for i in wanted), F.lit(0.0))
    gone = rated.where((F.col("rate") < least) & (own < 0.5)).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
