"""Line bitmaps, filter audits and collocations against plain versions on documents with everything that may go wrong."""

import hashlib
import os
import random
import re
import sys
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_samples import LOWER, collect, frame, nasty_texts, words  # noqa: E402

from cellgrid.llm import audit, lines, phrases  # noqa: E402

BLANKS = " \t\n\x0b\x0c\r"


# -- line dedup -----------------------------------------------------------------
def line_rows():
    rng = random.Random(3)
    rows = nasty_texts()
    common = ["Read More", "  read more\t", "READ MORE\r", "\x0bread more", " read more"]  # the last has another blank
    for i in range(100, 140):
        own = [f"own line {i} {k}" for k in range(4)]
        extra = [common[i % 5]] * (1 + i % 2) + (["often here"] * 12 if i == 101 else []) + (["shared by nine"] if i < 109 else []) + ["", "  "]
        text = own + extra
        rng.shuffle(text)
        rows.append((i, "\n".join(text)))
    rows += [(200 + i, "Ends with newline\nx\n") for i in range(12)] + [(None, "nameless\nread more")] * 3 + [(300, "read more\n" * 50_000 + "tail")]
    return rows


def plain_lines(rows, least=10, keep_first=False):
    """One answer per row; equal (id, text) are one document."""
    docs = {(i, t or "") for i, t in rows}
    found, holders = {}, defaultdict(set)
    for d in docs:
        keys = [x.strip(BLANKS).translate(LOWER) for x in d[1].split("\n")]
        found[d] = keys
        for k in keys:
            holders[k].add(d)
    common = {k for k, v in holders.items() if k and len(v) >= least}
    first = {}
    if keep_first:
        for d in sorted(d for d in docs if d[0] is not None):
            for p, k in enumerate(found[d]):
                first.setdefault(k, (d[0], p))
    out = []
    for i, t in rows:
        text = (t or "").split("\n")
        keys = found[(i, t or "")]
        kept = [x for p, (x, k) in enumerate(zip(text, keys, strict=True)) if k not in common or (keep_first and first.get(k) == (i, p))]
        out.append((i, len(text), len(text) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_common_lines_go(spark):
    rows = line_rows()
    docs = frame(spark, rows)
    made = lines.with_bitmap(docs, ["doc_id", "text"])
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in made.withColumn("kept", lines.kept_text(made["text"], made["keep"])).collect()), key=str)
    assert got == plain_lines(rows)
    assert any(n for _, _, n, _ in got)
    big = next(r for r in lines.line_bitmaps(docs).filter("doc_id = 300").collect())
    assert (big.n_lines, big.n_dropped, [tuple(k) for k in big.keep]) == (50_001, 50_000, [(50_000, 1)])


def test_first_occurrence_may_stay(spark):
    rows = [r for r in line_rows() if r[0] is not None]
    cut = lines.drop_lines(frame(spark, rows), keep_first=True)
    assert sorted(((r.doc_id, r.text or "") for r in cut.collect()), key=str) == sorted(((i, k) for i, _, _, k in plain_lines(rows, keep_first=True)), key=str)


@pytest.mark.parametrize("share", [1, 10**9])
def test_hot_and_rare_hashes_agree(spark, share, monkeypatch):
    monkeypatch.setattr(lines, "SHARE", share)
    rows = line_rows()
    got = sorted((r.doc_id, r.n_lines, r.n_dropped) for r in lines.line_bitmaps(frame(spark, rows)).collect() if r.doc_id is not None)
    assert got == sorted((i, n, d) for i, n, d, _ in plain_lines(rows) if i is not None)


def test_columns_that_clash_stay(spark):
    docs = frame(spark, line_rows())
    for name in ("n_lines", "n_dropped", "keep", "doc", "twin", "dropped", "count", "pos", "line", "h1", "__id"):
        docs = docs.withColumn(name, docs["doc_id"] * 7)
    cut = lines.drop_lines(docs)
    assert cut.columns == docs.columns
    assert collect(cut.drop("text", "n_chars")) == collect(docs.drop("text", "n_chars"))


def test_line_dedup_of_nothing(spark):
    docs = frame(spark, [])
    assert lines.line_bitmaps(docs).count() == 0 and lines.drop_lines(docs).count() == 0


# -- filter audit ---------------------------------------------------------------
AUDIT = "doc_id long, text string, source string, part string, mask int, h1 long, doc long, prefix string"


def audit_rows():
    rng = random.Random(8)
    rows = []
    for n, (i, t) in enumerate(nasty_texts()):
        rows.append((i, t, rng.choice(["a", "b", None, ""])))
        if n % 3 == 0:
            rows.append((1000 + n, t, "a"))
    for i in range(40):
        text = " ".join(rng.choice(["Aa", "bB", "cc", "DD", "#e"]) + str(rng.randrange(5 + i)) for _ in range(30 + i))
        rows += [(2000 + i, text, "b"), (3000 + i, text, "c")]
    return rows + [(5000, "hot text", "c")] + [(5001 + k, "hot text", "ab"[k % 2]) for k in range(60)]


def plain_audit(rows, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    docs = defaultdict(list)
    for i, t, s in rows:
        text, ws = t or "", words(t)
        fails = (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and first[text] < i)
        docs[s or ""].append(({f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good and i is not None, i in toxic and i is not None))
    out = []
    for part, rs in docs.items():
        steps, total = {}, Counter()
        for order in permutations("ABCDE"):
            for n, f in enumerate(order):
                before = set(order[:n])
                alive = [r for r in rs if not r[0] & before]
                gone = [r for r in alive if f in r[0]]
                total[f] += len(gone)
                steps["".join(order), n + 1] = (len(alive) - len(gone), len(gone), sum(f in r[0] and bool(r[0] & before) for r in rs), sum(r[0] == {f} for r in rs), sum(r[1] for r in gone), sum(r[2] for r in gone))
        out += [(part, o, n, *m, total[o[n - 1]]) for (o, n), m in steps.items()]
    return sorted(out)


@pytest.mark.parametrize("share", [1, 50, 10**9])
def test_audit_equals_plain_version(spark, share, monkeypatch):
    monkeypatch.setattr(audit, "SHARE", share)
    rows = audit_rows()
    docs = spark.createDataFrame([(i, t, s, "x", 1, 2, 3, "y") for i, t, s in rows], AUDIT)
    labels = [(i, k % 2, k % 3 % 2) for k, (i, _, _) in enumerate(rows)] + [(None, 1, 1), (2001, None, None), (2002, 1, 1), (2002, 0, 0)]
    made = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r) for r in made) == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], AUDIT)
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


# -- collocations ---------------------------------------------------------------
def phrase_rows():
    rng = random.Random(11)
    rows = [(t, rng.choice(["en", "und", None, "fr"])) for _, t in nasty_texts() if t is None or len(t) < 50_000]
    vocabulary = [f"w{i}" for i in range(40)] + ["the"] * 60 + ["of"] * 25
    for i in range(150):
        text = " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\t", "\n", "\x0b", ";x"]) for _ in range(60))
        rows.append((text + (" New  York City!new York city" if i % 2 else " of the"), ["en", "EN", None][i % 3]))
    return rows + [("Ünder der Brücke " * 30, "de"), ("a a a a a a a a a a a a a a", "de"), ("the the " * 400, "en")]


def plain_collocations(rows, least=10, percent=50, top=2000):
    total, f = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            ws = tuple(re.findall("[^ \t]+", piece))
            total[lang or "und"] += len(ws)
            for m in (1, 2, 3):
                f.update((lang or "und", ws[i : i + m]) for i in range(len(ws) - m + 1))
    candidates = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    inside = {(lang, part) for (lang, ws), n in candidates.items() if len(ws) == 3 for part in (ws[:2], ws[1:]) if 100 * n >= percent * f[lang, part]}
    scored = defaultdict(list)
    for (lang, ws), a in candidates.items():
        if (lang, ws) not in inside:
            score, k = min((10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
            scored[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, total[lang], -s) for lang, rows_ in scored.items() for r, (s, a, p, x, y) in enumerate(sorted(rows_)[:top], 1))


@pytest.mark.parametrize("budget,top", [(phrases.BUDGET, 2000), (40, 2000), (300, 25)])
def test_collocations_equal_plain_version(spark, budget, top, monkeypatch):
    """A small budget extends words and pairs of words, and makes many groups."""
    monkeypatch.setattr(phrases, "SHARE", 10**6)
    monkeypatch.setattr(phrases, "SLICE", 2_000)
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, g, "w", 1, 2, "n") for t, g in rows], "text string, lang string, word string, id long, w1 long, n string")
    got = sorted(tuple(r) for r in phrases.collocations(docs.repartition(5), budget=budget, top=top).collect())
    assert got == plain_collocations(rows, top=top)
    assert len({g for g, *_ in got}) >= 3


def test_groups_keep_to_the_budget():
    loads = {b: 1 + b % 7 for b in range(0, phrases.BUCKETS, 3)}
    group = phrases._pack(np.array([loads.get(b, 0) for b in range(phrases.BUCKETS)]), 100)
    held = Counter()
    for b, n in loads.items():
        held[group[b]] += n
    assert max(held.values()) <= 100 and sum(held.values()) == sum(loads.values()) and len(held) > 10


def test_scores_pass_64_bits(spark):
    a, x, y = 10**14 + 3, 10**14 + 7, 10**14 + 9
    df = spark.createDataFrame([(a, x, y)], "a long, l long, r long")
    assert df.select(phrases._score(df.a, df.l, df.r)).first()[0] == 10**6 * a * a // (x * y)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0
