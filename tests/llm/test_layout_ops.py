"""Shards, packing, archives, pages: exact laws and round trips."""

import itertools
import time
import zlib

import llm_samples as S
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from cellgrid.llm import html, sharding, warc
from cellgrid.llm.packing import pack, sequences
from cellgrid.llm.tokens import load_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = sharding.hilbert_index(list(cells.T), bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_shards_have_equal_counts_and_gapless_slots(spark):
    rows = S.nasty_texts()
    for docs in (S.frame(spark, rows), S.frame(spark, rows[:3]), S.frame(spark, rows).limit(0), S.frame(spark, [(9, "x")] * 21)):
        made = sharding.shard(docs, sharding.document_dimensions(), ["doc_id"], 8)
        assert set(docs.columns) <= set(made.columns)
        got = made.collect()
        assert len(got) == docs.count()
        counts = [sum(r["__shard"] == k for r in got) for k in range(8)]
        assert max(counts) - min(counts) <= 1
        for k in range(8):
            assert sorted(r["__slot"] for r in got if r["__shard"] == k) == list(range(counts[k]))
        order = [r["__place"] for r in sorted(got, key=lambda r: (r["__shard"], r["__slot"]))]
        assert order == sorted(order)


def test_shard_files(spark, tmp_path):
    made = sharding.shard(S.frame(spark, S.nasty_texts()), sharding.document_dimensions(), ["doc_id"], 4)
    sharding.write_shards(made, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(S.nasty_texts())


def test_packing(spark):
    rows = S.nasty_texts()
    tokenizer = load_tokenizer(PATH)
    for docs, window in ((S.frame(spark, rows).repartition(3), 2048), (S.frame(spark, rows).repartition(5, "lang"), 64)):
        pieces = pack(docs, PATH, window)
        got = pieces.collect()
        ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        want = sorted((str(i), tuple(ids(t))) for i, t in rows)
        total = sum(len(x) for _, x in want)
        by_sequence = {}
        for r in got:
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert r.length == len(r.ids) // 4 and r.length > 0
        assert sorted(by_sequence) == list(range(-(-total // window)))
        for k, parts in by_sequence.items():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at == (window if (k + 1) * window <= total else total % window)
        row = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(got, key=lambda r: (r.sequence_id, r.offset))])
        flat = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(sequences(pieces, window).select("sequence_id", "ids").collect(), key=lambda r: r.sequence_id) for r in [type("R", (), {"ids": np.array(r["ids"], "<u4").tobytes()})]])
        assert (row == flat).all() and len(row) == total
        found, begin = [], 0
        pieces_in_order = sorted(got, key=lambda r: (r.sequence_id, r.offset))
        while begin < len(pieces_in_order):
            first, size, parts = pieces_in_order[begin], 0, []
            assert first.start == 0
            while size < first.doc_tokens:
                p = pieces_in_order[begin]
                assert (p.start, p.doc_id, p.doc_tokens) == (size, first.doc_id, first.doc_tokens)
                parts.append(np.frombuffer(p.ids, "<u4"))
                size += p.length
                begin += 1
            found.append((str(first.doc_id), tuple(np.concatenate(parts).tolist())))
        assert sorted(found) == want
    assert pack(S.frame(spark, rows).limit(0), PATH).count() == 0


def test_packing_digest(spark):
    r = pack(S.frame(spark, [(1, "hello there")]), PATH).withColumn("c", F.crc32("ids")).first()
    ids = np.array(load_tokenizer(PATH).encode("hello there", add_special_tokens=False).ids + [1], "<u4")
    assert r.c == zlib.crc32(ids.tobytes())


PAGES = [(1, "u", "<p>a"), (5, "u2", "<p>a"), (3, None, None), (None, "x", "<p>a"), (7, "a b\n", ""), (8, "z", "é" * 10), (8, "z", "é" * 10), (None, "x", "q"), (9, "l", "y" * 3_000_000), (-2, "l", "y" * 3_000_000)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    payload = lambda h: (h or "").encode()
    latest = {}
    for i, _, h in PAGES:
        if i is not None:
            latest[payload(h)] = max(i, latest.get(payload(h), i))
    want = []
    for i, _, h in PAGES:
        top = latest.get(payload(h), i)
        want.append(str((i, len(payload(h)), warc.digest(payload(h)), "response" if top == i else "revisit", None if top == i else top, payload(h) if top == i else None)))
    got = warc.round_trip(pages).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got) == sorted(want)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_frames():
    import io

    import zstandard

    records = [warc.record(k, f"http://e/{k}", f"<p>{k} some page text</p>".encode() * 20, "D", 5, None) for k in range(300)]
    data, places = warc.archive(records)
    size = int.from_bytes(data[4:8], "little")
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    for (offset, length), item in zip(places, records, strict=True):
        assert zstandard.ZstdDecompressor(dict_data=words).decompress(data[offset : offset + length]) == item
    assert len(list(warc.read_archive(io.BytesIO(data)))) == 300
    assert sum(n for _, n in places) < sum(len(zstandard.compress(r)) for r in records)


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}</body></html>'


def test_pages():
    article = "<article><h1>Head &amp; line</h1><p><b>First   words\n of it.<br><p>Second &lt;one&gt; <a href='x'>link</a> here.</p><p>The third paragraph is longer than the others are.</p></article>"
    text = "Head & line\nFirst words of it.\nSecond <one> link here.\nThe third paragraph is longer than the others are."
    nav = '<nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>'
    rest = '<div class="ad">Buy a lot of things now, they are cheap and there are many of them today.</div><!-- <p>no</p> --><footer>&copy; me and a long line of other words in here</footer>'
    assert html.main_text(page(nav + article + rest)) == text
    assert html.main_text(page(nav + article + rest).replace("</body></html>", "")) == text
    comments = '<section id="comments"><p>A reader says something quite long about it.</p></section><form><p>Your name</p></form><aside>Side words</aside>'
    assert html.main_text(page("<header>Site name</header>" + nav + article + comments)) == text
    plain = article.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html.main_text(page(nav + plain + rest)) == text
    framed = '<div class="page with-sidebar"><div class="sidebar">Left out words</div>' + article + '<div class="comments"><article class="comment"><p>A reader says something.</p></article></div></div>'
    assert html.main_text(page(framed)) == text
    assert html.main_text(page(article.replace("<h1>", '<div class="article-header"><h1>').replace("</h1>", "</h1></div>"))) == text
    assert html.main_text(page("<p>Only this.</p>")) == "Only this."
    for empty in (None, "", "   ", "<html></html>", page(nav), "<!-- x", "<p"):
        assert html.main_text(empty) in ("", "<p")
    assert html.main_text("just text & more") == "just text & more"
    for deep in ("<div>" * 100_000 + "deep text", "<span>" * 100_000 + "<li>" * 5_000 + "deep text", "<div>" * 50_000 + "</p>" * 50_000 + "deep text"):
        assert html.main_text(deep) == "deep text"


def test_pages_with_text_in_several_wrappers():
    line = lambda k: (f"Sentence {k} has some words in it. " * 14).strip()
    half = lambda low: "<div>" + "".join(f"<p>{line(k)}</p>" for k in range(low, low + 5)) + "</div>"
    text = "\n".join(line(k) for k in range(10))
    advert = '<div class="ad"><p>Buy a lot of things now.</p></div>'
    nav = "<ul>" + "".join(f'<li><a href="/{k}">Section {k}</a></li>' for k in range(8)) + "</ul>"
    assert html.main_text(page(nav + "<div id=content>" + half(0) + advert + half(5) + "</div>" + nav)) == text
    assert html.main_text(page(nav + "<div id=content><div><h1>The headline</h1></div>" + half(0) + advert + half(5) + "</div>" + nav)) == "The headline\n" + text
    assert html.main_text(page(nav + half(0) + advert + half(5) + "<div><h2>More</h2>" + nav + "</div>")) == text
    loose = "Loose words between the halves of it. " * 40
    assert html.main_text(page(nav + "<div id=content>" + half(0) + loose + half(5) + "</div>")) == text.replace(line(5), loose.strip() + "\n" + line(5))
    assert html.main_text(page("<article>" + half(0) + "</article>" + nav + "<article>" + half(5) + "</article>")) == text


def test_pages_whose_names_resemble_furniture():
    line = "Some words of an article that go on for long enough to count as running text. " * 5
    parts = {"related-work": "Earlier work.", "social-history": "Social history.", "search-results-analysis": "Analysis of results."}
    body = "".join(f"<section id='{k}'><p>{v} {line}</p></section>" for k, v in parts.items())
    sources = "<h2>References</h2><ol><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ol>"
    cited = "<div class='references'><ul><li><a href=a>Third source</a></li><li><a href=b>Fourth source</a></li></ul></div>"
    furniture = "<div class='ad-box'>buy this</div><div class='related-posts'>more to read</div><div id=comments>first!</div>"
    got = html.main_text(f"<body><article><p>{line}</p>{body}{sources}{cited}{furniture}</article></body>")
    want = [line, *(f"{v} {line}" for v in parts.values()), "References", "First source", "Second source", "Third source", "Fourth source"]
    assert got == "\n".join(x.strip() for x in want)
    for name in ("left-side", "sidebar"):  # the only text of a page
        assert html.main_text(f"<body><div class='{name}'><p>{line}</p></div></body>") == line.strip()
    assert html.main_text(f"<body><div class='sidebar'>{line}</div><div class='text'><p>{line}!</p></div></body>") == line + "!"


def test_stray_quotes_take_linear_time():
    for bad in ("<a '\"", "<!x ", "<? ", "<a ", "<a<a", "<a b='\" "):
        for tail in ("", ">x"):
            start = time.perf_counter()
            html.main_text(bad * (1_000_000 // len(bad)) + tail)
            assert time.perf_counter() - start < 10  # quadratic searches take over an hour
    start = time.perf_counter()
    html.main_text("<p " + "a" * 1_000_000 + ">x")
    assert time.perf_counter() - start < 10
    assert html.main_text("<p title='a > b'>one</p> 1 < 2 <b c=\"d>") == "one\n1 < 2 <b c=\"d>"


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", page("<p>x y</p>"), "e"), (1, "u", page("<p>x y</p>"), "e"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert sorted(str((r.page_id, r.url, r.text, r.n_chars)) for r in got) == sorted(["(1, 'u', 'x y', 3)"] * 2 + ["(None, None, '', 0)"])
    assert html.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    """Every stage on rows of all kinds; columns stay those of documents."""
    import test_dedup_ops as D
    import test_model_ops as M

    rows = S.nasty_texts()
    docs = S.frame(spark, rows)
    labels = [(7, 1, 0), (10, 1, 0), (21, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(dict(rows)[21].split(" ")[20:60])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near dedup", "substring dedup", "decontamination", "packing"]
    out = stages["quality rules"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and all(not M.brute_base(r.text)[-1] for r in out.collect())
    out = stages["near dedup"](spark, docs, str(tmp_path))
    want = D.brute_components(rows, 5)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and want[i][1] == i)
    out = stages["decontamination"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and 21 not in {r.doc_id for r in out.collect()}
    for stage in list(stages.values())[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
