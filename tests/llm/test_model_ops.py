"""Quality rules, language-model scores, toxicity: against plain versions, and held-out accuracy."""

import math
import re
import tracemalloc
from collections import Counter

import llm_samples as S
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellgrid.llm import quality, scoring, toxicity


def spark_hash(*values, seed=42):
    """xxhash64 of strings and longs, as Spark chains it; the result is signed."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & (2**64 - 1)).to_bytes(8, "little")
        seed = xxhash.xxh64_intdigest(raw, seed & (2**64 - 1))
    return seed - 2**64 if seed >= 2**63 else seed


def brute_base(text):
    text = text or ""
    w = S.words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    out = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 50 or 100 * out[4] > 50 * out[0])


def brute_score(rows, good, n):
    feature = lambda t: [spark_hash(x) % n for x in S.words(t)] + [spark_hash(a, b) % n for a, b in zip(S.words(t), S.words(t)[1:])]
    corpus, trusted = [1] * n, [1] * n
    for i, t in rows:
        for b in feature(t):
            corpus[b] += 1
            trusted[b] += i in good
    shift = math.log(sum(corpus)) - math.log(sum(trusted))
    weights = [round(math.log(t) - math.log(c) + shift, 6) for t, c in zip(trusted, corpus)]
    if sum(trusted) == n:
        weights = [0.0] * n
    return [sum(weights[b] for b in feature(t)) / max(1, len(feature(t))) for _, t in rows]


@pytest.mark.parametrize("labelled", [[(7, 1, 0), (9, 1, 0), (9, 0, 0), (10, 1, 1), (21, 1, 0), (14, 0, 0), (None, 1, 0), (11, None, 0)], []])
def test_quality(spark, labelled):
    rows = S.nasty_texts()
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    docs = S.frame(spark, rows)
    got = quality.with_verdict(docs, labels, n=512, threshold=-0.05).collect()
    base = {(str(i), t): brute_base(t) for i, t in rows}
    score = {(str(i), t): s for (i, t), s in zip(rows, brute_score(rows, {7, 10, 21} if labelled else set(), 512))}
    assert len(got) == len(rows)
    for r in got:
        key = (str(r.doc_id), r.text)
        assert (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"], r["__base_failed"]) == base[key]
        assert abs(r["__score"] - score[key]) < 1e-9
        assert r["__kept"] == (not base[key][-1] and r["__score"] >= -0.05)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert quality.with_verdict(docs.limit(0), labels).count() == 0


def test_quality_with_prior(spark):
    rows, good, n = [(i, t) for i, t in S.nasty_texts() if t is None or len(t) < 5000], {7, 10, 21}, 512
    feature = lambda t: [spark_hash(x) % n for x in S.words(t)] + [spark_hash(a, b) % n for a, b in zip(S.words(t), S.words(t)[1:])]
    corpus, trusted = Counter(), Counter()
    for i, t in rows:
        corpus.update(feature(t))
        trusted.update(feature(t) if i in good else [])

    def brute(i, t):
        own = Counter(feature(t))
        total = 0.0
        for b, k in own.items():
            c, r = corpus[b] - k, trusted[b] - k * (i in good)
            share = (c + 1) / (corpus.total() - own.total() + n)
            total += k * math.log((r + 3 * n * share) / (trusted.total() - own.total() * (i in good) + 3 * n) / share)
        return total / max(1, own.total())

    labels = spark.createDataFrame([(7, 1), (10, 1), (21, 1), (14, 0)], "doc_id long, quality int")
    made = quality.with_verdict(S.frame(spark, rows), labels, n=n, prior=3.0)
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().executedPlan().toString())
    want = sorted((str((i, t)), brute(i, t)) for i, t in rows)
    got = sorted((str((r.doc_id, r.text)), r["__score"]) for r in made.collect())
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, want, strict=True))
    assert all(abs(r["__score"]) < 1e-9 for r in quality.with_verdict(S.frame(spark, rows), labels.limit(0), n=n, prior=3.0).collect())


@pytest.mark.parametrize("size,share", [("sf0.001", 1), ("sf0.001", 10), ("sf0.01", 1), ("sf0.01", 10), ("sf0.1", 1), ("sf0.1", 40)])
def test_clean_documents_stay_at_any_size(spark, size, share):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    some = labels.filter(f"pmod(xxhash64(doc_id), {share}) = 0")
    got = quality.with_verdict(docs.select("doc_id", "text"), some, prior=quality.PRIOR).filter("not __base_failed")
    got = got.join(labels.groupBy("doc_id").agg({"quality": "min"}).toDF("doc_id", "quality"), "doc_id", "left")
    kind = "case when quality = 1 then 'good' when quality = 0 then 'bad' when __n_symbols = 0 then 'clean' else 'other' end"
    found = {r["kind"]: (r["gone"], r["n"]) for r in got.groupBy(F.expr(kind).alias("kind")).agg(F.expr("count_if(not __kept)").alias("gone"), F.count("*").alias("n")).collect()}
    assert found["good"][1] > 50 and found["clean"][1] > 50
    assert all(100 * found[k][0] <= found[k][1] for k in ("good", "clean")), found
    assert (size, share) != ("sf0.1", 1) or 10 * found["bad"][0] > 9 * found["bad"][1]


def test_quality_plan_is_native(spark):
    docs = S.frame(spark, S.nasty_texts())
    plan = quality.with_verdict(docs, spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"), n=64)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("prior", [None, quality.PRIOR])
def test_quality_plan_holds_no_counts(spark, prior):
    labels = spark.createDataFrame([(7, 1), (14, 0)], "doc_id long, quality int")
    made = quality.with_verdict(S.frame(spark, S.nasty_texts()), labels, prior=prior)._jdf.queryExecution()
    assert len(made.executedPlan().toString()) < 200_000  # quality.BUCKETS numbers alone are more
    assert not re.search("__ratios|__in_|__weights", made.optimizedPlan().toString())  # no row holds an array of counts either


def brute_losses(texts, good, d=0.75, least=2):
    """(words, mean target loss minus background loss) of each text, by plain dictionaries."""
    docs = [[x.translate(S.LOWER) for x in S.words(t)] for t in texts]
    ring = lambda x: list(zip([None, *x], [*x, None])) if x else []
    counts = [Counter(w for x in docs for _, w in ring(x)), Counter(w for k, x in enumerate(docs) if k in good for _, w in ring(x))]
    pairs = [Counter(p for x in docs for p in ring(x)), Counter(p for k, x in enumerate(docs) if k in good for p in ring(x))]
    kept = {w for w, n in counts[0].items() if n >= least}
    symbol = lambda w: w if w in kept else "rest of words"
    seen = [Counter(), Counter()]
    for m in (0, 1):
        for w, n in counts[m].items():
            seen[m][symbol(w)] += n
    n = [sum(c.values()) for c in counts]

    def unigram(m, w):
        p = (seen[0][symbol(w)] + 1) / (n[0] + len(kept) + 1)
        if not m or not n[1]:
            return p
        return max(seen[1][symbol(w)] - d, 0) / n[1] + d * len(seen[1]) / n[1] * p

    stored, used = {p for p, k in pairs[0].items() if k >= least}, [Counter(), Counter()]
    for m in (0, 1):
        for a, w in stored:
            used[m][a] += max(pairs[m][a, w] - d, 0)

    def p(m, a, w):
        total = counts[m][a]
        if not total:
            return unigram(m, w)
        return (max(pairs[m][a, w] - d, 0) / total if (a, w) in stored else 0) + (1 - used[m][a] / total) * unigram(m, w)

    assert not n[1] or abs(sum(unigram(1, w) for w in [*kept, "never seen"]) - 1) < 1e-9
    return [(len(x), sum(math.log(p(0, a, w) / p(1, a, w)) for a, w in ring(x)) / (len(x) + 1)) for x in docs]


def check_scores(spark, rows, labels, good):
    want = sorted((str(i), *x) for (i, _), x in zip(rows, brute_losses([t for _, t in rows], good), strict=True))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in scoring.score(S.frame(spark, rows), labels).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4


def test_sums_of_a_task_are_merged_without_a_second_copy_of_all():
    tracemalloc.start()
    sums, n = scoring._Sums(), 200_000
    for low in (0, n // 2):  # half of the keys occur twice
        keys = np.arange(low, low + n, dtype=np.uint64)[::-1]
        sums.add(keys.copy(), np.ones(n, np.uint32), np.full(n, 2, np.uint32), keys + np.uint64(1), keys + np.uint64(2))
    parts = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    keys, corpus, target, context, word = sums.get()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.2 * parts
    assert (keys == np.arange(n + n // 2)).all() and (corpus.sum(), target.sum()) == (2 * n, 4 * n)
    assert (corpus[n // 2 : n] == 2).all() and (context == keys + 1).all() and (word == keys + 2).all()


@pytest.mark.parametrize("frequent", [0, 100, scoring.FREQUENT])
def test_scoring(spark, monkeypatch, frequent):
    monkeypatch.setattr(scoring, "FREQUENT", frequent)
    rows = [(i, t) for i, t in S.nasty_texts() if t is None or len(t) < 5000]
    labels = spark.createDataFrame([(7, 1), (9, 1), (9, 0), (10, 1), (None, 1), (21, 1)], "doc_id long, quality int")
    check_scores(spark, rows, labels, {k for k, (i, _) in enumerate(rows) if i in (7, 10, 21)})
    check_scores(spark, rows, labels.limit(0), set())
    assert scoring.score(S.frame(spark, rows).limit(0), labels).count() == 0
    assert {r.score for r in scoring.score(S.frame(spark, rows[:4]), labels.limit(0)).collect() if r.n_tokens == 0} == {0.0}


def test_scoring_keeps_every_word_seen_twice(spark):
    rows = [(i, " ".join(f"w{(i * 2_500 + k) % 90_000}" for k in range(5_000))) for i in range(36)]  # 90,000 words, each twice
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(36)], "doc_id long, quality int")
    _, totals = scoring.fit(scoring.mark_target(S.frame(spark, rows), labels))
    assert totals.symbols == 90_002 and totals.rest == (0, 0)
    check_scores(spark, rows, labels, set(range(0, 36, 5)))


def test_scoring_shards_and_copies(spark, monkeypatch):
    docs, labels = S.frame(spark, S.nasty_texts()), spark.createDataFrame([(7, 1), (10, 1)], "doc_id long, quality int")
    one = S.collect(scoring.score(docs, labels))
    for name, value in {"SHARD_ENTRIES": 500, "COUNT_ENTRIES": 3_000, "CELL_ENTRIES": 300, "CHUNK_BYTES": 400, "HELD_ENTRIES": 2_000, "FREQUENT": 200}.items():
        monkeypatch.setattr(scoring, name, value)
    many = S.collect(scoring.score(docs, labels))
    for a, b in zip(one, many, strict=True):
        assert a[:2] == b[:2] and abs(a[2][1] - b[2][1]) < 1e-5


def test_kneser_ney_against_plain_formula():
    grams = np.array([0x0101616200, 0x0101616263, 0x0101616264, 0x0161626300], np.uint64)
    toxic, ordinary = np.array([3, 0, 1, 2]), np.array([1, 5, 0, 2])
    found = toxicity.fit(grams, toxic, ordinary)
    key = lambda g, n: g & ((1 << 8 * n) - 1)

    def shared(g, n):  # continuation probability of an n-gram
        if n == 0:
            return 1 / 257
        level = {int(x) for x in grams}
        for m in range(4, n, -1):
            level = {key(x, m) for x in level}
        cont = Counter(key(x, n) for x in level)
        same = [k for k in cont if k >> 8 == key(g, n) >> 8]
        total = sum(cont[k] for k in same)
        return max(cont[key(g, n)] - 0.75, 0) / total + 0.75 * len(same) / total * shared(g, n - 1)

    for k, g in enumerate(map(int, grams)):
        logs = []
        for c in (toxic, ordinary):
            same = [j for j in range(len(grams)) if int(grams[j]) >> 8 == g >> 8]
            total, kinds = sum(c[j] for j in same), sum(c[j] > 0 for j in same)
            weight = 0.75 * kinds / total if total else 1.0
            logs.append(math.log((max(c[k] - 0.75, 0) / total if total else 0) + weight * shared(g, 4)))
        assert abs(found.values[k] - (logs[0] - logs[1])) < 1e-9


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    hits = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert hits / got.predicted.sum() > 0.85 and hits / got.toxic.sum() > 0.8
    assert got.score.between(0, 1).all()


def test_toxicity_of_odd_rows(spark):
    rows = S.nasty_texts()
    docs = S.frame(spark, rows)
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows)] + [(7, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.filter("toxic = 1")):
        got = toxicity.score(docs, toxicity.train(docs, some)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
