"""Registered queries of the training-data operators: thin callers that derive the digest columns."""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.llm import decontaminate, divergence, filter_audit, line_dedup, near_dedup, quality, secret_scan, sharding, sp_codec, substring, token_files, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_read(spark, sf_dir, "embeddings"), scale=256)
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, similarity=Fraction(85, 100))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    network = quality.train(docs, _read(spark, sf_dir, "labels"), learnable=~quality.held_out("id"))
    scored = quality.with_score(docs.select("doc_id", "text"), network, "score")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode_texts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex", "cnn")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_read(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_source_divergence": op11_source_divergence,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_files": op13_token_files,
}
ORACLE: dict[str, str] = {
    "op2_near_dedup": r"""
        with recursive w as (
          select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
        s as (
          select doc_id, case when ws is null or len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
            else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end sh from w),
        e as (select doc_id, len(sh) n, unnest(sh) x from s),
        p as (
          select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c
          from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
        l as (select a, b from p where 100 * c >= 85 * (na + nb - c)),
        g as (select a, b from l union select b, a from l),
        r as (select doc_id, doc_id reached from s union select r.doc_id, g.b from r join g on g.a = r.reached),
        c as (select doc_id, min(reached) component_id from r group by doc_id)
        select doc_id, len(sh)::bigint n_shingles, component_id, doc_id = component_id kept from s join c using (doc_id)""",
    "op6_line_dedup": r"""
        with l as (
          select doc_id, unnest(string_split(text, chr(10))) ln, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents),
        w as (
          select doc_id, line_no, ln, doc_id * 10000000 + line_no place,
            regexp_extract_all(translate(ln, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from l),
        k as (select *, array_to_string(ws, ' ') k from w),
        d as (select k, any_value(ws) ws, min(place) first from k where len(ws) > 0 group by k),
        v as (
          select k, first, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') v
          from (select *, unnest(range(1, len(ws) + 1)) i from d where len(ws) >= 8)),
        near as (
          select a.k from v a join v b on a.v = b.v and a.i = b.i where b.first < a.first
          union select a.k from v a join d b on a.v = b.k and len(b.ws) >= 8 where b.first < a.first
          union select b.k from v a join d b on a.v = b.k and len(b.ws) >= 8 where a.first < b.first),
        gone as (
          select k.doc_id, k.line_no from k join d using (k) where k.place <> d.first
          union select doc_id, line_no from k where k in (select k from near)),
        r as (
          select k.doc_id, count(*) filter (where len(ws) > 0)::int n_lines, count(g.line_no)::int n_removed,
            sha256(coalesce(string_agg(ln, chr(10) order by k.line_no) filter (where g.line_no is null), '')) text_sha256
          from k left join gone g on k.doc_id = g.doc_id and k.line_no = g.line_no group by k.doc_id)
        select doc_id, n_lines, n_removed, text_sha256 from r""",
    "op1_topk_search": """
        with v as (
          select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
          where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
          select q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint score
          from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
        select query_id, "rank", vec_id, score from r where "rank" <= 5""",
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x, strlen(coalesce(html, ''))::bigint n from pages),
        d as (
          select page_id, n, x, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((
              (strpos('0123456789abcdef', substr(x, (5 * i // 4 + 1)::int, 1)) - 1) * 16
              + strpos('0123456789abcdef', substr(x || '0', (5 * i // 4 + 2)::int, 1)) - 1)::int >> (3 - (5 * i) % 4)::int) & 31) + 1, 1)), '') payload_digest
          from p),
        m as (select x, max(page_id) latest from d group by x)
        select page_id, n payload_bytes, payload_digest, case when page_id = latest then 'response' else 'revisit' end record_type,
               case when page_id <> latest then latest end refers_to
        from d join m using (x)""",
    "op11_source_divergence": r"""
        with d as (
          select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') x from documents),
        w as (select id, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
        c as (select lang, source, term, count(*)::hugeint n from w group by all),
        k as (select lang, term from (select distinct lang, term, id from w) group by lang, term having count(*) >= 30),
        g as (select distinct lang, source from d),
        v as (select lang, count(*)::hugeint v from k group by lang),
        t as (select g.lang, g.source, k.term, coalesce(c.n, 0) n from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        p as (select lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) over (partition by lang, source) + 5 * v) p from t join v using (lang)),
        q as (
          select lang, term, 1 + 1000000000 * (n + 5) // (sum(n) over (partition by lang) + 5 * v) q
          from (select lang, term, sum(n)::hugeint n from t group by lang, term) join v using (lang)),
        f as (
          select a.lang, a.source, 'pair' part, b.source item, sum(abs(a.p - b.p)) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
          union all
          select a.lang, a.source, 'pair', b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from v)
          union all
          select lang, source, 'term', term, p - q from p join q using (lang, term) where n > 0 and p > q),
        r as (select *, row_number() over (partition by lang, source, part order by value desc, item) r from f)
        select lang, source, part, item, value::bigint "value", r::int "rank" from r where part = 'pair' or r <= 50""",
    "op12_filter_audit": r"""
        with t as (
          select doc_id, coalesce(source, '') part, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
        y as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
        m as (
          select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
            len(ws) < 50 A, 100 * len(list_distinct(ws)) < 65 * len(ws) B, 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 5 * length(x) C,
            regexp_matches(x, '[#$%&*|]') D, coalesce(t.doc_id > min(t.doc_id) over (partition by x), false) E
          from t left join y on t.doc_id = y.doc_id),
        c as (
          select part, list_filter([case when A then 'A' end, case when B then 'B' end, case when C then 'C' end, case when D then 'D' end, case when E then 'E' end], lambda f: f is not null) fails,
            count(*) n, sum(good) good, sum(toxic) toxic from m group by all),
        l as (select unnest(['A', 'B', 'C', 'D', 'E']) f),
        o as (
          select a.f || b.f || c.f || d.f || e.f filter_order from l a, l b, l c, l d, l e
          where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s as (
          select part, filter_order, step, substr(filter_order, step, 1) f, fails, n, good, toxic,
            len(list_filter(fails, lambda x: strpos(filter_order, x) < step)) earlier
          from c, o, (select unnest(range(1, 6)) step)),
        r as (
          select part, filter_order, step::int step, f,
            sum(n) filter (where earlier = 0 and not list_contains(fails, f)) kept, sum(n) filter (where earlier = 0 and list_contains(fails, f)) removed,
            sum(n) filter (where earlier > 0 and list_contains(fails, f)) redundant, sum(n) filter (where fails = [f]) unique_fails,
            sum(good) filter (where earlier = 0 and list_contains(fails, f)) good_lost, sum(toxic) filter (where earlier = 0 and list_contains(fails, f)) toxic_lost
          from s group by all)
        select part, filter_order, step, coalesce(kept, 0)::bigint kept, coalesce(removed, 0)::bigint removed, coalesce(redundant, 0)::bigint redundant,
          coalesce(unique_fails, 0)::bigint unique_fails, coalesce(good_lost, 0)::bigint good_lost, coalesce(toxic_lost, 0)::bigint toxic_lost,
          sum(coalesce(removed, 0)) over (partition by part, f)::bigint shapley
        from r""",
}
