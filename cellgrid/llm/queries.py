"""One query per operator: the operator with its production parameters over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_path(spark: SparkSession) -> str:
    """``spark.cellgrid.tokenizer`` names a vocabulary file that every executor has; otherwise the public one installed beside Python."""
    import public_tokenizers

    return spark.conf.get("spark.cellgrid.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.packing import pack

    pieces = pack(_table(spark, sf, "documents"), tokenizer_path(spark))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.scoring import score

    return score(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.sharding import document_dimensions, shard

    docs = _table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    made = shard(rows, document_dimensions(), ["doc_id", "text_crc32"])
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__place").alias("place"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.decontamination import contaminated, find_spans, n_hit

    found = find_spans(_table(spark, sf, "documents").select("doc_id", "text"), _table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.quality import PRIOR, with_verdict

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return with_verdict(docs, _table(spark, sf, "labels"), prior=PRIOR).select("doc_id", *(F.col(f"__{c}").alias(c) for c in columns))


def op2_minhash(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf, "documents"))


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.substrings import removal_digest

    return removal_digest(_table(spark, sf, "documents"))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.toxicity import score, train

    docs = _table(spark, sf, "documents")
    return score(docs, train(docs, _table(spark, sf, "labels")))


def op8_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.html import extract

    return extract(_table(spark, sf, "pages"))


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.warc import round_trip

    return round_trip(_table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.phrases import collocations

    return collocations(_table(spark, sf, "documents"))


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.audit import audit

    return audit(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from cellgrid.llm.lines import kept_text, with_bitmap

    made = with_bitmap(_table(spark, sf, "documents"), ["doc_id", "text"])
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_minhash": op2_minhash,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_html_extraction": op8_html_extraction,
    "op9_warc": op9_warc,
    "op10_packing": op10_packing,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL: dict[str, str] = {
    "op2_minhash": f"""
        with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_SPACED}) ws from documents),
        s as (select distinct doc_id, array_to_string(ws[k:k + 3], ' ') s
              from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) k from d where len(ws) > 0)),
        n as (select doc_id, count(*) n from s group by 1),
        l as (select a, b from (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2) p
              join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
        r as (select doc_id node, doc_id top from documents union select l.b, r.top from r join l on l.a = r.node)
        select d.doc_id, coalesce(n.n, 0) n_shingles, min(top) component_id, min(top) = d.doc_id kept
        from d left join n using (doc_id) join r on r.node = d.doc_id group by d.doc_id, n.n""",
    "op3_substring_dedup": f"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) ws from documents),
        w as (select doc_id, k, array_to_string(ws[k:k + 34], ' ') w from (select doc_id, ws, unnest(range(1, len(ws) - 33)) k from d where len(ws) >= 35)),
        r as (select doc_id, k from w semi join (select w from w group by w having count(*) > 1) using (w)),
        gone as (select distinct doc_id, unnest(range(k, k + 35)) p from r),
        kept as (select doc_id, p, ws[p] x from (select doc_id, ws, unnest(range(1, len(ws) + 1)) p from d) anti join gone using (doc_id, p)),
        s as (select doc_id, count(*) n, string_agg(x, ' ' order by p) t from kept group by 1)
        select d.doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(t, '')) kept_sha256
        from d left join s using (doc_id)""",
    "op6_decontamination": f"""
        with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) ws from documents),
        i as (select distinct item_id, regexp_extract_all({_LOWER}, {_ALNUM}) ws from benchmark where item_id is not null),
        iw as (select distinct item_id, least(13, len(ws)) m, array_to_string(ws[k:k + least(13, len(ws)) - 1], ' ') w
               from (select item_id, ws, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) k from i where len(ws) > 0)),
        dw as (select doc_id, k, m, array_to_string(ws[k:k + m - 1], ' ') w
               from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) k from d, (select distinct m from iw) where len(ws) >= m)),
        hits as (select distinct doc_id, k, m, item_id from dw join iw using (m, w)),
        words as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(k, k + m)) p from hits) group by 1),
        items as (select doc_id, count(*) n, string_agg(item_id, ',' order by item_id) ids
                  from (select distinct doc_id, cast(item_id as varchar) item_id from hits) group by 1)
        select d.doc_id, cast(len(ws) as bigint) n_words, coalesce(words.n, 0) n_hit, coalesce(items.n, 0) n_items,
               sha256(coalesce(items.ids, '')) items_sha256,
               coalesce(words.n, 0) > 0 and 20 * coalesce(words.n, 0) >= len(ws) contaminated
        from d left join words using (doc_id) left join items using (doc_id)""",
    "op11_collocations": rf"""
        with d as (select coalesce(lang, 'und') lang, doc_id, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) piece from documents),
        w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from d),
        g as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') p, any_value(ws[i:i + m - 1]) ws, count(*) f
              from (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) i from w, (select unnest(range(1, 4)) m) where len(ws) >= m) group by 1, 2, 3),
        n as (select lang, cast(sum(f) as bigint) n from g where m = 1 group by 1),
        c as (select * from g where m > 1 and f >= 10),
        inside as (select lang, array_to_string(ws[1:2], ' ') p, f from c where m = 3 union all select lang, array_to_string(ws[2:3], ' '), f from c where m = 3),
        kept as (select * from c anti join (select c.lang, c.p from c join inside i on c.lang = i.lang and c.p = i.p and c.m = 2 where 100 * i.f >= 50 * c.f) using (lang, p)),
        cut as (select c.lang, c.p, c.f a, k, x.f l, y.f r, (1000000::hugeint * c.f * c.f) // (x.f::hugeint * y.f) score
                from (select *, unnest(range(1, m)) k from kept) c
                join g x on x.lang = c.lang and x.p = array_to_string(c.ws[:k], ' ') join g y on y.lang = c.lang and y.p = array_to_string(c.ws[k + 1:], ' ')),
        one as (select * from (select *, row_number() over (partition by lang, p order by score, k) q from cut) where q = 1)
        select lang, rank, p phrase, cast(a as bigint) a, cast(l as bigint) l, cast(r as bigint) r, n, cast(score as bigint) score
        from (select *, row_number() over (partition by lang order by score desc, a desc, encode(p)) rank from one) join n using (lang) where rank <= 2000""",
    "op12_filter_audit": r"""
        with d as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
        m as (select part, quality = 1 good, toxic = 1 toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
                  100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * len(t), regexp_matches(t, '[#$%&*|]'),
                  coalesce(doc_id > min(doc_id) over (partition by t), false)] f
              from d left join labels using (doc_id)),
        c as (select part, f, count(*) n, count(*) filter (good) good, count(*) filter (toxic) toxic from m group by all),
        l as (select unnest(range(1, 6)) x),
        o as (select [a.x, b.x, c.x, d.x, e.x] o from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s as (select o, step, o[step] x, o[:step - 1] earlier from o, (select unnest(range(1, 6)) step)),
        r as (select part, o, step, x, f[x] fails, list_bool_or(list_transform(earlier, lambda e: f[e])) is true gone,
                  len(list_filter(f, lambda b: b)) = 1 alone, n, good, toxic from c, s),
        a as (select part, o, step, x, sum(case when not fails and not gone then n else 0 end) kept, sum(case when fails and not gone then n else 0 end) removed,
                  sum(case when fails and gone then n else 0 end) redundant, sum(case when fails and alone then n else 0 end) unique_fails,
                  sum(case when fails and not gone then good else 0 end) good_lost, sum(case when fails and not gone then toxic else 0 end) toxic_lost from r group by all)
        select part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') filter_order, cast(step as integer) step, cast(kept as bigint) kept,
               cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost,
               cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) shapley from a""",
    "op13_line_dedup": r"""
        with d as (select doc_id, str_split(coalesce(text, ''), chr(10)) ls from documents),
        l as (select doc_id, p, ls[p] line, translate(trim(ls[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
              from (select doc_id, ls, unnest(range(1, len(ls) + 1)) p from d)),
        c as (select k from l where k <> '' group by k having count(distinct doc_id) >= 10),
        s as (select doc_id, count(*) n, string_agg(line, chr(10) order by p) t from l anti join c using (k) group by 1)
        select d.doc_id, cast(len(ls) as bigint) n_lines, cast(len(ls) - coalesce(n, 0) as bigint) n_dropped, sha256(coalesce(t, '')) kept_sha256
        from d left join s using (doc_id)""",
    "op9_warc": """
        with h as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) x from pages),
        d as (select page_id, cast(strlen(html) as bigint) payload_bytes,
              array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((
                  cast('0x' || substr(x, cast(1 + 5 * (j // 4) as integer), 5) as integer) >> cast(15 - 5 * (j % 4) as integer)) & 31) as integer), 1)), '') payload_digest from h),
        m as (select payload_digest, max(page_id) top from d group by 1)
        select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end record_type,
               case when page_id <> top then top end refers_to
        from d join m using (payload_digest)""",
}
