"""Near duplicates, repeats, contamination: against brute force on documents with everything that may go wrong."""

import hashlib
import random
from collections import Counter, defaultdict

import llm_samples as S
import pytest

from cellgrid.llm.decontamination import WORDS as ALNUM
from cellgrid.llm.decontamination import contaminated, decontaminate, find_spans, n_hit
from cellgrid.llm.neardup import components, keep_one, near_duplicates, sketch
from cellgrid.llm.substrings import remove_repeats, removal_digest


def shingles(text, size):
    w = S.words((text or "").translate(S.LOWER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(rows, size=4, percent=80):
    named = {}
    for i, t in rows:
        if i is not None and (t is not None or i not in named):
            named[i] = shingles(t, size)
    top = {i: i for i in named}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in named:
        for b in named:
            if a < b and named[a] and 100 * len(named[a] & named[b]) >= percent * len(named[a] | named[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(named[i]), find(i)) for i in named}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    rows = S.nasty_texts()
    want = brute_components(rows, size)
    got = near_duplicates(S.frame(spark, rows), size).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_open_buckets_are_resolved(spark):
    """A star whose arms are no links of each other, with chains; many buckets hold several components."""
    rng = random.Random(8)
    base = S.sentence(rng, 150).split(" ")
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for k in rng.sample(range(150), rng.choice([1, 2, 3, 5, 8, 12])):
            w[k] = f"x{i}{k}"
        rows.append((i, " ".join(w)))
    w = list(base)
    for i in range(200, 230):  # a chain: each differs a little from the one before
        w = list(w)
        for k in rng.sample(range(150), 2):
            w[k] = f"y{i}{k}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows)
    got = near_duplicates(S.frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 5


def test_keep_one_keeps_columns(spark):
    rows = S.nasty_texts()
    docs = S.frame(spark, rows)
    got = keep_one(docs, 4)
    assert got.columns == docs.columns
    want = brute_components(rows)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and want[i][1] == i)
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0


def test_one_row_of_each_component_survives_the_next_stage(spark):
    rng = random.Random(8)
    a, b, c, d, e = (S.sentence(rng, 60) for _ in range(5))
    rows = [(2, a), (2, a), (2, a), (3, a + " tail"), (None, a), (None, b), (None, b), (None, b + " tail"), (4, c), (5, d), (5, e), (6, None), (6, None), (7, e + " TAIL")]
    got = keep_one(S.frame(spark, rows)).select("doc_id", "text", "lang")
    kept = got.collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept if r.doc_id is not None) == sorted(map(str, [(2, a), (4, c), (5, d), (5, e), (6, None), (6, None)]))
    assert [r.text in (b, b + " tail") for r in kept if r.doc_id is None] == [True]
    words = lambda rows_: sorted((str(r.doc_id), S.words(r.text)) for r in rows_)
    assert words(remove_repeats(got).collect()) == words(kept)


def test_sketch_fills_every_bin_and_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 1 << 62, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.concatenate([common, a]), np.concatenate([common, b]), common[:1]]
    docs = np.repeat(np.arange(3), [len(x) for x in sets])
    out = sketch(docs, np.concatenate(sets), 3, 128)
    assert (out != np.iinfo(np.uint64).max).all()
    assert abs((out[0] == out[1]).mean() - 0.8) < 0.15
    assert (sketch(docs[docs == 2] - 2, sets[2], 1, 128)[0] == out[2]).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 9)] + [(209, 200 + i) for i in range(9)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 9)} | {200 + i: 200 for i in range(1, 10)} or all(
        got.get(i, i) == c for i, c in [(40, 0), (0, 0), (108, 100), (209, 200), (208, 200)]
    )


def brute_kept(rows, window):
    starts = defaultdict(list)
    texts = [S.words(t) for _, t in rows]
    for d, w in enumerate(texts):
        for k in range(len(w) - window + 1):
            starts[tuple(w[k : k + window])].append((d, k))
    gone = [set() for _ in rows]
    for places in starts.values():
        if len(places) > 1:
            for d, k in places:
                gone[d].update(range(k, k + window))
    return [[x for p, x in enumerate(w) if p not in gone[d]] for d, w in enumerate(texts)], texts


@pytest.mark.parametrize("window,group_rows", [(35, 1000), (35, 1), (14, 2)])
def test_repeats(spark, window, group_rows):
    rows = S.nasty_texts()
    kept, texts = brute_kept(rows, window)
    want = sorted((str(i), len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), w, k in zip(rows, texts, kept))
    docs = S.frame(spark, rows)
    got = removal_digest(docs, window=window, group_rows=group_rows).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    cut = remove_repeats(docs, window=window, group_rows=group_rows)
    assert cut.columns == docs.columns
    assert sorted((str(r.doc_id), S.words(r.text)) for r in cut.collect()) == sorted((str(i), k) for (i, _), k in zip(rows, kept))
    assert removal_digest(docs.limit(0)).count() == 0


def test_repeats_leave_other_texts_alone(spark):
    rows = [(1, "  odd \t spacing\n\nstays "), (2, None), (3, "")]
    got = remove_repeats(S.frame(spark, rows)).collect()
    assert {r.doc_id: r.text for r in got} == dict(rows)


def normal(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(S.LOWER))


def brute_hits(text, items, window):
    w, hit, names = normal(text), set(), set()
    for name, t in items:
        x = normal(t)
        if name is None or not x:
            continue
        m = min(window, len(x))
        grams = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)}
        for k in range(len(w) - m + 1):
            if tuple(w[k : k + m]) in grams:
                hit.update(range(k, k + m))
                names.add(str(name))
    return len(w), len(hit), ",".join(sorted(names))


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("block_words", [10_000, 30])
def test_contamination(spark, short, block_words):
    rng = random.Random(4)
    items = [(i, S.sentence(rng, 40, 60)) for i in range(12)] + [(12, "w1 w2 w3 w4"), (3, "repeated id " * 9), (None, S.sentence(rng, 20, 60)), (13, ""), (14, None)]
    if short:
        items += [(15, "single"), (16, "w5, w6"), (17, "w5")]
    rows = [(100 + i, S.sentence(rng, 20, 60) + " " + " ".join(items[i % 12][1].split(" ")[3 : 3 + n]).upper() + "! " + S.sentence(rng, m, 60)) for i, (n, m) in enumerate([(12, 5), (13, 5), (30, 900), (37, 2), (13, 300), (20, 0)])]
    rows += [(300, items[0][1]), (301, "Single"), *S.nasty_texts()]
    docs, benchmark = S.frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = find_spans(docs.select("doc_id", "text"), benchmark, block_words=block_words).withColumn("hit", n_hit()).withColumn("bad", contaminated()).collect()
    want = [(str(i), *brute_hits(t, items, 13)) for i, t in rows]
    assert sorted((str(r.doc_id), r["__n_words"], r.hit, ",".join(r["__items"])) for r in got) == sorted(want)
    assert sorted(str(r.doc_id) for r in got if r.bad) == sorted(i for i, n, h, _ in want if h and 20 * h >= n)
    clean = decontaminate(docs, benchmark)
    assert clean.columns == docs.columns
    left = {(str(r.doc_id), r.text) for r in clean.collect()}
    for (i, t), (_, n, h, _) in zip(rows, want):
        if not h:
            assert (str(i), t) in left
    assert not any(20 * h >= n for i, t in left for n, h in [brute_hits(t, items, 13)[:2]] if h)


def test_contamination_of_nothing(spark):
    docs, benchmark = S.frame(spark, S.nasty_texts()), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_spans(docs.limit(0), benchmark).count() == 0
    assert decontaminate(docs, benchmark.limit(0)).count() == docs.count()
    assert ALNUM.lower and Counter()[0] == 0
