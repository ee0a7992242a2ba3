"""DuckDB twins of the registered queries (same tables, same semantics).

Plain SQL of its own: patterns, lists and sizes are written out here rather than
taken from the Spark side, and the similarity is computed by its definition
(union vocabulary, direct norms).
"""

from __future__ import annotations


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "'the','of','and','to','in','de','la','le','et','und','der','que'"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
INTEGER = _q(rf"^{BLANKS}*[-+]?\p{{Nd}}+(?:_\p{{Nd}}+)*{BLANKS}*$")

# a text of the glued files
BRACED = """(text || CASE WHEN doc_id % 5 = 2 THEN chr(10) || 'say "}{" ' || chr(92) || '}{ {"x":"}{"' ELSE '' END)"""

ARTICLES = """
articles AS (
  SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title,
         CASE WHEN d.lang = 'en' THEN 'news' ELSE d.lang END AS section,
         nullif(d.source, 'src0') AS source, CASE WHEN d.doc_id % 97 <> 0 THEN e.ts END AS pub_ts,
         CAST(1 + d.doc_id % 3 AS INTEGER) AS depth, d.text
  FROM documents d LEFT JOIN events e ON d.doc_id = e.event_id
  WHERE length(d.text) > 0)"""

TOKENS = f"""
toks AS (
  SELECT doc_id, term FROM (SELECT doc_id, unnest({WORDS}) AS term FROM articles)
  WHERE length(term) > 0 AND term NOT IN ({STOP}))"""

WEIGHTS = f"""{ARTICLES},{TOKENS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
m AS (SELECT count(*) AS m FROM articles),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, tf.tf, dfq.df,
             tf.tf * ln(CAST(m.m + 1 AS DOUBLE) / CAST(dfq.df + 1 AS DOUBLE)) AS tfidf
      FROM tf JOIN dfq ON tf.term = dfq.term CROSS JOIN m)"""

RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term ASC) AS rnk
  FROM w)"""

SIMS = f"""{WEIGHTS},{RANKED},
kws AS (SELECT doc_id, term FROM ranked WHERE rnk <= 20),
met AS (
  SELECT DISTINCT least(k.doc_id, t.doc_id) AS lo, greatest(k.doc_id, t.doc_id) AS hi
  FROM kws k JOIN tf t ON k.term = t.term AND k.doc_id <> t.doc_id),
vocabulary AS (
  SELECT lo, hi, term FROM met JOIN kws ON doc_id = lo UNION SELECT lo, hi, term FROM met JOIN kws ON doc_id = hi),
sims AS (
  SELECT v.lo, v.hi, CAST(sum(coalesce(a.tf, 0) * coalesce(b.tf, 0)) AS BIGINT) AS dot,
         CAST(sum(coalesce(a.tf, 0) * coalesce(a.tf, 0)) AS BIGINT) AS norm_lo,
         CAST(sum(coalesce(b.tf, 0) * coalesce(b.tf, 0)) AS BIGINT) AS norm_hi,
         CAST(sum(coalesce(a.tf, 0) * coalesce(b.tf, 0)) AS DOUBLE)
           / sqrt(CAST(sum(coalesce(a.tf, 0) * coalesce(a.tf, 0)) AS DOUBLE) * CAST(sum(coalesce(b.tf, 0) * coalesce(b.tf, 0)) AS DOUBLE)) AS sim
  FROM vocabulary v LEFT JOIN tf a ON a.doc_id = v.lo AND a.term = v.term LEFT JOIN tf b ON b.doc_id = v.hi AND b.term = v.term
  GROUP BY v.lo, v.hi)"""

VOTES = f"""
votes AS (
  SELECT doc_id, count(*) AS votes FROM (
    SELECT lo AS doc_id FROM sims WHERE sim >= 0.3
    UNION ALL SELECT hi FROM sims WHERE sim >= 0.3)
  GROUP BY doc_id)"""

HOT = f"""{SIMS},{VOTES},
dated AS (
  SELECT a.*, date_sub('minute', a.pub_ts, {NOW}) AS age FROM articles a WHERE a.pub_ts IS NOT NULL),
scored AS (
  SELECT d.doc_id, d.title, coalesce(v.votes, 0) AS votes, d.age,
         CASE WHEN d.section = 'news'
              THEN (CAST(coalesce(v.votes, 0) - 1 AS DOUBLE) / (CAST(d.age + 2 AS DOUBLE) * 9.8))
                   * ((10 - d.depth) * (10 - d.depth)) * 3
              ELSE (CAST(coalesce(v.votes, 0) - 1 AS DOUBLE) / (CAST(d.age + 2 AS DOUBLE) * 9.8))
                   * ((10 - d.depth) * (10 - d.depth)) END AS raw
  FROM dated d LEFT JOIN votes v ON v.doc_id = d.doc_id),
bounds AS (SELECT min(raw) AS lo, max(raw) AS hi FROM scored),
hot AS (
  SELECT s.*, coalesce((s.raw - b.lo) / nullif(b.hi - b.lo, 0) * 100, 0.0) AS hotness
  FROM scored s CROSS JOIN bounds b)"""

RELATED = f"""{HOT},
live AS (
  SELECT p.lo, p.hi, p.sim FROM sims p
  JOIN dated a1 ON a1.doc_id = p.lo JOIN dated a2 ON a2.doc_id = p.hi
  WHERE p.sim > 0 AND a1.section = a2.section AND abs(a1.age - a2.age) <= 1440),
cand AS (SELECT lo AS doc_id, hi AS other, sim FROM live UNION ALL SELECT hi, lo, sim FROM live),
named AS (
  SELECT c.doc_id, d.title, max(c.sim) AS sim FROM cand c JOIN dated d ON d.doc_id = c.other
  GROUP BY c.doc_id, d.title),
rel AS (
  SELECT * FROM (
    SELECT doc_id, title, sim,
           CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 9) DESC, title ASC) AS INTEGER) AS rank
    FROM named)
  WHERE rank <= 10)"""

KEYWORDS = f"""
kw AS (SELECT doc_id, CAST(rnk AS INTEGER) AS rank, term, tf, tfidf FROM ranked WHERE rnk <= 20)"""

SENT = f"""{ARTICLES},
sent AS (
  SELECT doc_id, pub_ts,
         array_to_string(list_filter({WORDS}, lambda x: length(x) > 0 AND NOT list_contains([{STOP}], x)), ' ') AS value
  FROM articles WHERE pub_ts IS NOT NULL)"""


def _history(seconds: int) -> str:
    return f"""{SENT},
words AS (SELECT pub_ts, unnest(string_split(value, ' ')) AS word FROM sent),
wc AS (
  SELECT time_bucket(INTERVAL {seconds} SECOND, pub_ts, TIMESTAMP '1970-01-01') AS ws, word, count(*) AS n
  FROM words GROUP BY 1, 2),
hist AS (
  SELECT * FROM (
    SELECT strftime(ws + INTERVAL {seconds} SECOND, '%Y-%m-%d %H:%M:%S') AS batch_time, word AS keyword, n,
           CAST(row_number() OVER (PARTITION BY ws ORDER BY n DESC, word ASC) AS INTEGER) AS rank
    FROM wc WHERE length(word) > 0 AND NOT regexp_matches(word, {INTEGER}))
  WHERE rank <= 20)"""


SENTENCES = _history(61)

LINES_WORDS = """
lines AS (SELECT unnest(string_split(text, chr(10))) AS value FROM {src}),
words AS (SELECT unnest(string_split(value, ' ')) AS word FROM lines)"""


REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _decode(expr: str) -> str:
    expr = f"list_reduce(list_prepend({expr}, list_distinct(regexp_extract_all({expr}, '&#([0-9]{{1,9}});', 1))), lambda s, c: replace(s, '&#' || c || ';', chr(CAST(c AS INTEGER))))"
    expr = f"list_reduce(list_prepend({expr}, list_distinct(regexp_extract_all({expr}, '&#x([0-9a-f]{{1,6}});', 1))), lambda s, c: replace(s, '&#x' || c || ';', chr(CAST('0x' || c AS INTEGER))))"
    for ent, ch in REFERENCES:
        expr = f"replace({expr}, {_q(ent)}, {_q(ch)})"
    return expr


def _strip(expr: str) -> str:
    return f"regexp_replace({expr}, {_q(f'^{BLANKS}+|{BLANKS}+$')}, '', 'g')"


def _default(expr: str) -> str:
    return f"coalesce(nullif({_strip(expr)}, ''), '#')"


def _canon(expr: str) -> str:
    return f"regexp_replace({expr}, '[?#].*$', '')"


def _host(expr: str) -> str:
    return f"lower(regexp_extract({expr}, '^[a-zA-Z][-+.a-zA-Z0-9]*://([^/?#:]+)', 1))"


def _section(expr: str) -> str:
    return f"CASE WHEN split_part({_host(expr)}, '.', 2) = 'news' THEN 'news' ELSE split_part({_host(expr)}, '.', 1) END"


def _extracted(source: str) -> str:
    """Articles of a page table: blocks, title, time, source, paragraphs."""
    return f"""
blocks AS (
  SELECT page_id, url, html, array_to_string(regexp_extract_all(html, '(?s)<article[^>]*>(.*?)</article>', 1), chr(10)) AS m FROM {source}),
cut AS (SELECT *, CASE WHEN length(m) > 0 THEN m ELSE html END AS blk FROM blocks),
raw AS (
  SELECT page_id, url, regexp_replace(regexp_extract(blk, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS h,
         rtrim({_strip("regexp_extract(html, '(?s)class=\"post_time_source\"[^>]*>([^<]*)', 1)")}, '　来源: ') AS t,
         regexp_extract(html, '(?s)class="post_time_source".*?<a[^>]*>([^<]*)</a>', 1) AS s,
         list_transform(string_split_regex(blk, '<p(?:[ \\t\\r\\n][^>]*)?>')[2:], lambda x:
           regexp_replace(regexp_extract(x, '(?s)^(.*?)(?:</p[ \\t\\r\\n]*>.*)?$', 1), '<[^>]*>', '', 'g')) AS ps
  FROM cut),
ex AS (
  SELECT page_id, {_canon('url')} AS url, {_default(_decode('h'))} AS title, {_section(_canon('url'))} AS section,
         {_default('t')} AS time, coalesce(nullif({_strip(_decode('s'))}, ''), '#') AS source,
         list_filter(list_transform(ps, lambda p: {_strip(_decode('p'))}), lambda p: length(p) > 0) AS content
  FROM raw)"""


MARKED = """marked AS (
  SELECT page_id, url, html || '<div class="post_time_source"> '
    || CASE WHEN page_id % 5 = 0 THEN '' ELSE printf('2024-01-02 03:04:%02d　来源: ', page_id % 60) END
    || CASE WHEN page_id % 3 = 0 THEN '<a href="/s">Desk &amp; Co</a>' ELSE '' END || '</div>'
    || '<article><p>one <b>two</b> three &#39;&#x4e2d;</p><p> </p><p class=''x''>open ' || page_id || '<p>　last&nbsp;</p></article>' AS html
  FROM pages)"""
NESTED = ("<div class='post_text wide'><p>outer <i>a</i><article class=\"in\"><div><div>x<br>y</div></div><p>open <b>bold<li>item<ul><li>one<li>two</ul></article>"
          "<table><tr><td>1<td>2<tr><th>h</table></b> a < b <!-- <p>no</p> --><style>p{}</style><p>tail</div></div>end")
PIECES = (r"(?is)<!--.*?(?:-->|\z)|<script(?:[\s/][^>]*)?>.*?(?:</script[^>]*>|\z)|<style(?:[\s/][^>]*)?>.*?(?:</style[^>]*>|\z)|<[!?][^>]*(?:>|\z)"
          r"|</?[a-z](?:[^>'\"]|\"[^\"]*\"|'[^']*')*>|</?[a-z][^>]*>|[^<]+|<")
VOID_NAMES = "'area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr'"
BLOCK_NAMES = ("'address','article','aside','blockquote','div','dl','fieldset','footer','form','h1','h2','h3','h4','h5','h6',"
               "'header','hr','main','nav','ol','p','pre','section','table','ul'")

_scheme = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
_origin = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"


def _links(source: str) -> str:
    """Followable links: anchors, any quoting, references decoded, resolved against the page."""
    return f"""
tags AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<(?:a|area)[ \\t\\r\\n][^>]*>')) AS tag FROM {source}),
written AS (
  SELECT page_id, url, regexp_extract(tag, '(?is)[ \\t\\r\\n"''/]href[ \\t\\r\\n]*=[ \\t\\r\\n]*("[^"]*"|''[^'']*''|[^ \\t\\r\\n"''>]+)', 1) AS w FROM tags),
bare AS (SELECT page_id, url, regexp_replace(w, '^["'']|["'']$', '', 'g') AS b FROM written WHERE length(w) > 0),
hrefs AS (SELECT page_id, url, {_canon(_strip(_decode('b')))} AS h, {_strip(_decode('b'))} AS full_h FROM bare),
joined AS (
  SELECT page_id, {_canon('url')} AS src,
         CASE WHEN regexp_matches(full_h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
              WHEN starts_with(full_h, '//') THEN {_scheme} || ':' || h
              WHEN starts_with(full_h, '/') THEN {_origin} || h
              WHEN h = '' THEN {_canon('url')}
              ELSE {_origin} || coalesce(nullif(regexp_extract(substr({_canon('url')}, length({_origin}) + 1), '^(.*/)', 1), ''), '/') || h END AS u
  FROM hrefs),
parts AS (
  SELECT page_id, src, u, regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)', 1) AS o FROM joined WHERE regexp_matches(lower(u), '^https?://[^/]')),
paths AS (SELECT *, string_split(substr(u, length(o) + 1), '/') AS seg FROM parts),
links AS (
  SELECT page_id, src, CASE WHEN NOT contains(substr(u, length(o) + 1), '/.') THEN u ELSE
      o || array_to_string(list_reduce(list_transform(seg, lambda x: [x]), lambda a, x:
             CASE WHEN x[1] = '.' THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] ELSE list_concat(a, x) END), '/')
        || CASE WHEN seg[-1] IN ('.', '..') THEN '/' ELSE '' END END AS dst
  FROM paths)"""


_h = _host("url")
ALLOWED = f"""(({_h} = 'example.com' OR ends_with({_h}, '.example.com') OR {_h} = 'example.net' OR ends_with({_h}, '.example.net'))
        AND regexp_matches(url, '^https?://[^/]+/[a-z]{{2}}/[0-9]+(\\.html|/)?([?#].*)?$'))"""
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
HAN = "translate(lower(text), 'aeiourstnh', '中文汉字测试数据分析')"

STOP_LIST = r"""
stoplist AS (
  SELECT DISTINCT w AS term FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS w FROM benchmark) WHERE length(w) > 0)"""


ORACLE: dict[str, str] = {
    "y1_article_keywords": f"""WITH {WEIGHTS},{RANKED},{KEYWORDS}
SELECT doc_id, rank, term, tf, round(tfidf, 6) AS tfidf FROM kw""",

    "t5_doc_freq": f"""WITH {WEIGHTS}
SELECT term, df, round(ln(CAST(m + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE)), 6) AS idf FROM dfq CROSS JOIN m""",

    "t6_tfidf": f"""WITH {WEIGHTS}
SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf FROM w""",

    "y2_block_keywords": f"""WITH {ARTICLES},{TOKENS},
thr AS (SELECT min(doc_id) AS t FROM (SELECT doc_id FROM articles ORDER BY doc_id DESC LIMIT 100)),
mb AS (SELECT count(*) FILTER (WHERE doc_id < (SELECT t FROM thr)) + 1 AS m FROM articles),
bt AS (SELECT CASE WHEN doc_id >= (SELECT t FROM thr) THEN -1 ELSE doc_id END AS doc_id, term FROM toks),
btf AS (SELECT doc_id, term, count(*) AS tf FROM bt GROUP BY doc_id, term),
bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY term),
bw AS (SELECT btf.doc_id, btf.term, btf.tf,
              btf.tf * ln(CAST(mb.m + 1 AS DOUBLE) / CAST(bdf.df + 1 AS DOUBLE)) AS tfidf
       FROM btf JOIN bdf ON btf.term = bdf.term CROSS JOIN mb)
SELECT CAST(row_number() OVER (ORDER BY round(tfidf, 9) DESC, term ASC) AS INTEGER) AS rank,
       term, tf, round(tfidf, 6) AS tfidf
FROM bw WHERE doc_id = -1 ORDER BY round(tfidf, 9) DESC, term ASC LIMIT 20""",

    "t9_rolling_block": f"""WITH {ARTICLES},{TOKENS},
thr AS (SELECT min(doc_id) AS t FROM (SELECT doc_id FROM articles ORDER BY doc_id DESC LIMIT 100)),
mb AS (SELECT count(*) FILTER (WHERE doc_id < (SELECT t FROM thr)) + 1 AS m FROM articles),
bt AS (SELECT CASE WHEN doc_id >= (SELECT t FROM thr) THEN -1 ELSE doc_id END AS doc_id, term FROM toks),
btf AS (SELECT doc_id, term, count(*) AS tf FROM bt GROUP BY doc_id, term),
bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY term),
bw AS (SELECT btf.doc_id, btf.term, btf.tf,
              btf.tf * ln(CAST(mb.m + 1 AS DOUBLE) / CAST(bdf.df + 1 AS DOUBLE)) AS tfidf
       FROM btf JOIN bdf ON btf.term = bdf.term CROSS JOIN mb)
SELECT CAST(row_number() OVER (ORDER BY round(tfidf, 9) DESC, term ASC) AS INTEGER) AS rank,
       term, tf, round(tfidf, 6) AS tfidf
FROM bw WHERE doc_id = -1 ORDER BY round(tfidf, 9) DESC, term ASC LIMIT 20""",

    "j1_pair_similarity": f"""WITH {SIMS}
SELECT lo, hi, dot, norm_lo, norm_hi, round(sim, 6) AS sim FROM sims""",

    "j3_votes": f"""WITH {SIMS},{VOTES}
SELECT doc_id, votes FROM votes""",

    "y4_hotness": f"""WITH {HOT}
SELECT doc_id, votes, age, round(raw, 9) AS raw, round(hotness, 6) AS hotness FROM hot""",

    "r4_hot_board": f"""WITH {HOT}
SELECT CAST(row_number() OVER (ORDER BY hotness DESC, doc_id ASC) AS INTEGER) AS rank, doc_id,
       round(hotness, 6) AS hotness
FROM hot ORDER BY hotness DESC, doc_id ASC LIMIT 50""",

    "y3_related_articles": f"""WITH {RELATED}
SELECT doc_id, rank, title, round(sim, 6) AS sim FROM rel""",

    "y5_hot_news_report": f"""WITH {RELATED},{KEYWORDS},
kwa AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS keyword FROM kw GROUP BY doc_id),
rla AS (SELECT doc_id, string_agg(title, ' | ' ORDER BY rank) AS samenews FROM rel GROUP BY doc_id)
SELECT a.doc_id, a.title, round(h.hotness, 6) AS attention,
       coalesce(kwa.keyword, '') AS keyword, coalesce(rla.samenews, '') AS samenews
FROM articles a LEFT JOIN hot h ON h.doc_id = a.doc_id
LEFT JOIN kwa ON kwa.doc_id = a.doc_id LEFT JOIN rla ON rla.doc_id = a.doc_id""",

    "a1_word_count": f"""WITH {LINES_WORDS.format(src='documents')}
SELECT word, count(*) AS n FROM words GROUP BY word""",

    "a1_conversation_word_count": f"""WITH {LINES_WORDS.format(src='conversations')}
SELECT word, count(*) AS n FROM words GROUP BY word""",

    "a2_top_words": f"""WITH {LINES_WORDS.format(src='documents')},
wc AS (SELECT word, count(*) AS n FROM words GROUP BY word)
SELECT CAST(row_number() OVER (ORDER BY n DESC, word ASC) AS INTEGER) AS rank, word, n
FROM wc WHERE length(word) > 0 AND NOT regexp_matches(word, {INTEGER})
ORDER BY n DESC, word ASC LIMIT 20""",

    "a3_source_counts": f"""WITH {ARTICLES}
SELECT coalesce(source, 'undefined') AS source, count(*) AS n FROM articles GROUP BY 1""",

    "a4_hour_grid": f"""WITH {ARTICLES},
days AS (SELECT DISTINCT strftime(pub_ts, '%Y-%m-%d') AS day FROM articles WHERE pub_ts IS NOT NULL),
grid AS (SELECT day, CAST(unnest(range(0, 24)) AS INTEGER) AS hour FROM days),
cnt AS (SELECT strftime(pub_ts, '%Y-%m-%d') AS day, CAST(hour(pub_ts) AS INTEGER) AS hour, count(*) AS n
        FROM articles WHERE pub_ts IS NOT NULL GROUP BY 1, 2)
SELECT g.day, g.hour, printf('%d:00-%d:00', g.hour, g.hour + 1) AS hour_label, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN cnt c ON c.day = g.day AND c.hour = g.hour""",

    "a5_distinct_urls": f"""SELECT count(DISTINCT {_canon('url')}) AS n_urls FROM pages""",

    "w1_window_word_count": f"""WITH {SENTENCES}
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, word, n FROM wc""",

    "w1_event_counts": f"""SELECT strftime(time_bucket(INTERVAL 61 SECOND, ts,
                                TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
       event_type, count(*) AS n
FROM events GROUP BY 1, 2""",

    "w3_word_history": f"""WITH {SENTENCES}
SELECT batch_time, rank, keyword, n FROM hist""",

    "w2_word_history_20s": f"""WITH {_history(20)}
SELECT batch_time, rank, keyword, n FROM hist""",

    "w2_word_history_90s": f"""WITH {_history(90)}
SELECT batch_time, rank, keyword, n FROM hist""",

    "w3_batches_by_arrival": f"""WITH lines AS (
  SELECT printf('2024-01-01 00:00:%02d.000', conv_id % 60) AS batch_time, unnest(string_split(text, chr(10))) AS value FROM conversations),
words AS (SELECT batch_time, unnest(string_split(value, ' ')) AS keyword FROM lines),
wc AS (SELECT batch_time, keyword, count(*) AS n FROM words WHERE length(keyword) > 0 AND NOT regexp_matches(keyword, {INTEGER}) GROUP BY 1, 2)
SELECT * FROM (
  SELECT batch_time, CAST(row_number() OVER (PARTITION BY batch_time ORDER BY n DESC, keyword) AS INTEGER) AS rank, keyword, n FROM wc)
WHERE rank <= 20""",

    "s1_concat_json": f"""SELECT CASE WHEN doc_id % 7 <> 3 THEN doc_id END AS doc_id, CASE WHEN doc_id % 7 <> 3 THEN source END AS source,
       CASE WHEN doc_id % 7 <> 3 THEN lang END AS lang, CASE WHEN doc_id % 7 <> 3 THEN {BRACED} ELSE '' END AS text, doc_id % 7 = 3 AS torn
FROM documents""",

    "s1_cut_everywhere": f"""WITH d AS (
  SELECT *, {BRACED} AS t, CASE WHEN doc_id % 7 = 3 THEN 0 ELSE (length({BRACED}) - length(replace({BRACED}, '}}{{', ''))) // 2 END AS cuts FROM documents),
p AS (SELECT *, unnest(range(cuts + 1)) AS piece, doc_id % 7 = 3 OR cuts > 0 AS torn FROM d)
SELECT CASE WHEN NOT torn THEN doc_id END AS doc_id, CASE WHEN NOT torn THEN source END AS source,
       CASE WHEN NOT torn THEN lang END AS lang, CASE WHEN NOT torn THEN t ELSE '' END AS text, torn FROM p""",

    "s2_article_records": f"""SELECT 'https://news.example.com/' || doc_id || '.html' AS url,
       coalesce(nullif(regexp_replace(split_part(text, chr(10), 1), '^{BLANKS}+|{BLANKS}+$', '', 'g'), ''), '#') AS title, lang AS section, source,
       CASE WHEN doc_id % 11 <> 0 THEN printf('2024-01-02 03:%02d:%02d', doc_id % 60, doc_id % 59) END AS pub_time,
       CAST(1 + doc_id % 3 AS INTEGER) AS depth, md5(replace(text, chr(10), '')) AS text_md5
FROM documents WHERE length(replace(text, chr(10), '')) > 0""",

    "s5_text_files": """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
SELECT md5(value) AS line_md5, count(*) AS n FROM l GROUP BY 1""",

    "s7_stream_counts": f"""WITH {LINES_WORDS.format(src='documents')}
SELECT word, count(*) AS n FROM words GROUP BY word""",

    "s8_stream_history": f"""WITH {LINES_WORDS.format(src='documents')},
wc AS (SELECT word, count(*) AS n FROM words GROUP BY word)
SELECT CAST(row_number() OVER (ORDER BY n DESC, word ASC) AS INTEGER) AS rank, word AS keyword, n
FROM wc WHERE length(word) > 0 AND NOT regexp_matches(word, {INTEGER})
ORDER BY n DESC, word ASC LIMIT 20""",

    "w1_event_time_counts": f"""WITH {SENTENCES}
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, word, n FROM wc""",

    "w1_late_lines": f"""WITH {SENT}
SELECT count(*) + count(*) FILTER (WHERE doc_id % 50 = 0) + 1 AS lines, count(*) AS counted, CAST(1 AS BIGINT) AS open,
       count(*) FILTER (WHERE doc_id % 50 = 0) AS late FROM sent""",

    "w4_quiet_batches": f"""WITH words AS (
  SELECT CAST(conv_id % 3 // 2 + 1 AS INTEGER) AS frame, unnest(string_split(line, ' ')) AS keyword
  FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations WHERE conv_id % 3 <> 1)),
wc AS (SELECT frame, keyword, count(*) AS n FROM words WHERE length(keyword) > 0 AND NOT regexp_matches(keyword, {INTEGER}) GROUP BY 1, 2),
r AS (SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY n DESC, keyword) AS INTEGER) AS rank, keyword, n FROM wc)
SELECT frame, rank, keyword, n FROM r WHERE rank <= 20""",

    "s6_snapshot": f"""WITH {WEIGHTS},{RANKED},
thr AS (SELECT min(doc_id) AS t FROM (SELECT doc_id FROM articles ORDER BY doc_id DESC LIMIT 100)),
mb AS (SELECT count(*) FILTER (WHERE doc_id < (SELECT t FROM thr)) + 1 AS m FROM articles),
btf AS (SELECT CASE WHEN doc_id >= (SELECT t FROM thr) THEN -1 ELSE doc_id END AS doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY term),
bw AS (SELECT term, round(tf * ln(CAST(mb.m + 1 AS DOUBLE) / CAST(df + 1 AS DOUBLE)), 9) AS w9 FROM btf JOIN bdf USING (term) CROSS JOIN mb WHERE doc_id = -1),
top AS (SELECT term, w9 FROM bw ORDER BY w9 DESC, term LIMIT 20)
SELECT CAST(doc_id AS VARCHAR) AS key, string_agg(term, ' ' ORDER BY rnk) AS words FROM ranked WHERE rnk <= 20 GROUP BY doc_id
UNION ALL SELECT strftime({NOW}, '%Y-%m-%d %H:%M:%S'), string_agg(term, ' ' ORDER BY w9 DESC, term) FROM top""",

    "s12_split_history": f"""WITH {SENTENCES}
SELECT batch_time AS batch_minute, rank, keyword || CASE rank % 5 WHEN 0 THEN '],"k": [' WHEN 1 THEN '],' ELSE '' END AS keyword, n FROM hist""",

    "a5_daily_sketches": f"""WITH {_links('pages')},
d AS (SELECT CAST(unnest(range(page_id % 7, 7)) AS INTEGER) AS upto, dst FROM links)
SELECT upto, count(DISTINCT dst) AS n_urls, true AS near FROM d GROUP BY upto""",

    "s9_article_store": f"""WITH crawled AS (
  SELECT page_id, url, html FROM pages
  UNION ALL SELECT page_id + 1000000000, {_canon('url')} || '?again=1', html FROM pages WHERE page_id % 10 = 1),
{_extracted('crawled')},
batches AS (SELECT 1 AS batch, * FROM ex WHERE page_id % 2 = 0 UNION ALL SELECT 2, * FROM ex)
SELECT page_id, url, title, batch FROM batches WHERE len(content) > 0
QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch, page_id) = 1""",

    "s9_bucketed_store": f"""WITH crawled AS (
  SELECT page_id, url, html FROM pages
  UNION ALL SELECT page_id + 1000000000, {_canon('url')} || '?again=1', html FROM pages WHERE page_id % 10 = 1),
{_extracted('crawled')},
batches AS (SELECT 1 AS batch, * FROM ex WHERE page_id % 2 = 0 UNION ALL SELECT 2, * FROM ex)
SELECT page_id, url, title, batch FROM batches WHERE len(content) > 0
QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch, page_id) = 1""",

    "j4_seen_store": f"""WITH {_links('pages')}
SELECT DISTINCT dst AS url FROM links WHERE dst NOT IN (SELECT dst FROM links WHERE page_id % 2 = 0)""",

    "s10_token_files": f"""WITH {SENT}
SELECT strftime(pub_ts, '%Y%m%d%H%M') AS minute, value FROM sent""",

    "c2_seen_urls": f"""WITH t AS (SELECT '{{"url": "' || url || '", "from": "https://x.org/%41?q=ü"}} ' || regexp_replace(html, '[\\r\\n]', ' ', 'g') AS t FROM pages)
SELECT DISTINCT unnest(regexp_extract_all(t, {_q(URL_PATTERN)})) AS url FROM t""",

    "s3_stopword_list": f"""WITH {STOP_LIST}
SELECT term FROM stoplist""",

    "j5_stopword_antijoin": f"""WITH {ARTICLES},{STOP_LIST},
every AS (SELECT doc_id, unnest({WORDS}) AS term FROM articles)
SELECT doc_id, count(*) AS n, count(DISTINCT term) AS n_terms FROM every
WHERE length(term) > 0 AND term NOT IN (SELECT term FROM stoplist) GROUP BY doc_id""",

    "t2_table_sentences": f"""WITH {ARTICLES},{STOP_LIST},
every AS (SELECT doc_id, unnest(range(len({WORDS}))) AS pos, unnest({WORDS}) AS term FROM articles),
kept AS (SELECT doc_id, count(*) AS n, string_agg(term, ' ' ORDER BY pos) AS sentence FROM every
         WHERE length(term) > 0 AND term NOT IN (SELECT term FROM stoplist) GROUP BY doc_id)
SELECT a.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_words, coalesce(sentence, '') AS sentence FROM articles a LEFT JOIN kept USING (doc_id)""",

    "s6_report_rows": f"""WITH {WEIGHTS},{RANKED}
SELECT doc_id, CAST(to_json({{'doc_id': doc_id, 'keyword': list(term ORDER BY rnk)}}) AS VARCHAR) AS value FROM ranked WHERE rnk <= 20 GROUP BY doc_id""",

    "s10_token_lines": f"""WITH {SENT}
SELECT doc_id, strftime(pub_ts, '%Y%m%d%H%M') AS minute, value FROM sent""",

    "s11_legacy_counts": f"""WITH {LINES_WORDS.format(src='documents')},
c AS (SELECT word, count(*) AS n FROM words GROUP BY word)
SELECT word || CASE WHEN length(word) % 5 = 0 THEN chr(39) || chr(92) || 'x' ELSE '' END AS word, n FROM c""",

    "s12_history_json": f"""WITH {SENTENCES}
SELECT batch_time, rank, keyword, n FROM hist""",

    "r5_history_frames": f"""WITH {SENTENCES}
SELECT batch_time,
       CAST(row_number() OVER (PARTITION BY batch_time ORDER BY n ASC, keyword ASC) AS INTEGER) AS pos,
       keyword, n
FROM hist""",

    "y8_ingest_pages": f"""WITH crawled AS (
  SELECT page_id, url, html FROM pages
  UNION ALL SELECT page_id + 1000000000, {_canon('url')} || '?again=1', html FROM pages WHERE page_id % 10 = 1),
{_extracted('crawled')},
firsts AS (SELECT url, min(page_id) AS page_id FROM ex WHERE len(content) > 0 GROUP BY url),
seen AS (SELECT {_canon('url')} AS url FROM pages WHERE page_id % 2 = 0)
SELECT ex.page_id, ex.url, ex.title, ex.section, ex.time, ex.source,
       CAST(len(ex.content) AS INTEGER) AS n_paragraphs, array_to_string(ex.content, ' ') AS content_text
FROM ex JOIN firsts f ON f.page_id = ex.page_id AND f.url = ex.url
WHERE ex.url NOT IN (SELECT url FROM seen)""",

    "p14_marked_pages": f"""WITH {MARKED},
{_extracted('marked')}
SELECT page_id, title, time, source, CAST(len(content) AS INTEGER) AS n_paragraphs, array_to_string(content, '|') AS content_text
FROM ex WHERE len(content) > 0""",

    "p14_element_tree": f"""WITH RECURSIVE src AS (SELECT page_id, html || {_q(NESTED)} AS html FROM pages),
cut AS (SELECT page_id, regexp_extract_all(html, {_q(PIECES)}) AS ps FROM src),
piece AS (SELECT page_id, unnest(ps) AS raw, generate_subscripts(ps, 1) AS i FROM cut),
named AS (
  SELECT page_id, i, raw, lower(regexp_extract(raw, '^</?([A-Za-z][^\\s/>]*)', 1)) AS name,
         CASE WHEN NOT starts_with(raw, '<') OR raw = '<' THEN 'text' WHEN regexp_matches(raw, '(?i)^<(?:script|style)[\\s/>]|^<[!?]') THEN 'none'
              WHEN starts_with(raw, '</') THEN 'close' ELSE 'open' END AS kind,
         list_filter(string_split_regex(regexp_replace(regexp_extract(raw, '(?is)[\\s"''/]class\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '["'']', '', 'g'), '\\s+'),
                     lambda c: regexp_matches(c, '^[A-Za-z0-9_-]+$')) AS classes
  FROM piece),
k AS (
  SELECT page_id, kind, raw, name, array_to_string(list_concat([name], classes), '.') AS step, row_number() OVER (PARTITION BY page_id ORDER BY i) AS i,
         CASE WHEN name IN ({BLOCK_NAMES}) THEN ['p'] WHEN name = 'li' THEN ['li'] WHEN name IN ('dt', 'dd') THEN ['dt', 'dd'] WHEN name = 'tr' THEN ['tr', 'td', 'th']
              WHEN name IN ('td', 'th') THEN ['td', 'th'] WHEN name = 'option' THEN ['option'] ELSE [] END AS ends,
         CASE WHEN name IN ({BLOCK_NAMES}) THEN ['button', 'caption', 'object', 'table', 'td', 'th'] WHEN name = 'li' THEN ['ol', 'ul'] WHEN name IN ('dt', 'dd') THEN ['dl']
              WHEN name = 'tr' THEN ['table'] WHEN name IN ('td', 'th') THEN ['table', 'tr'] ELSE ['select'] END AS borders
  FROM named WHERE kind <> 'none'),
tree(page_id, i, names, steps, text) AS (
  SELECT page_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM src
  UNION ALL
  SELECT page_id, i, CASE WHEN adds THEN list_concat(names[1:stay], [name]) ELSE names[1:stay] END, CASE WHEN adds THEN list_concat(steps[1:stay], [step]) ELSE steps[1:stay] END, text
  FROM (
    SELECT k.page_id, k.i, t.names, t.steps, k.name, k.step, CASE WHEN kind = 'text' THEN raw END AS text,
           kind = 'open' AND k.name NOT IN ({VOID_NAMES}) AS adds,
           CASE kind
             WHEN 'open' THEN coalesce(list_min(list_filter(range(1, len(names) + 1), lambda j: list_contains(ends, names[j])
                  AND j > coalesce(list_max(list_filter(range(1, len(names) + 1), lambda b: list_contains(borders, names[b]))), 0))) - 1, len(names))
             WHEN 'close' THEN coalesce(list_max(list_filter(range(1, len(names) + 1), lambda j: names[j] = k.name)) - 1, len(names))
             ELSE len(names) END AS stay
    FROM tree t JOIN k ON k.page_id = t.page_id AND k.i = t.i + 1))
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS no, CAST(len(names) AS INTEGER) AS depth,
       '/' || array_to_string(steps, '/') AS path, text FROM tree WHERE text IS NOT NULL""",

    "p14_tree_articles": f"""WITH {MARKED},
{_extracted('marked')}
SELECT page_id, title, time, source, CAST(len(content) AS INTEGER) AS n_paragraphs, array_to_string(content, '|') AS content_text
FROM ex WHERE len(content) > 0""",

    "p5_url_fields": f"""WITH u AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '://([^./]+)[.]', '://\\1.news.') ELSE url END AS url FROM pages)
SELECT page_id, {_canon('url')} AS canonical, {_host('url')} AS host, {_section('url')} AS section,
       CASE WHEN NOT contains(url, '.news') THEN 'nation' ELSE split_part({_host('url')}, '.', 1) END AS province,
       {ALLOWED} AS allowed
FROM u""",

    "p15_links": f"""WITH {_links('pages')}
SELECT page_id, src, dst FROM links""",

    "p15_link_forms": f"""WITH forms AS (
  SELECT page_id, url, html || '<a href=''#top''><a href="?p=2"><a class="c" href=../q.html><A HREF = ''./a/../b/./c''><a href="mailto:a@b.c">'
    || '<a href="//h.example/x/.."><a href="/p?a=1&amp;b=2#f"><a href=""><a data-href="no"><link href="style.css">'
    || '<area href=''/%20map''><a href="HTTPS://H.example/k"><a href="&#47;dec">' AS html FROM pages),
{_links('forms')}
SELECT page_id, src, dst FROM links""",

    "j4_unseen_urls": f"""WITH {_links('pages')}
SELECT DISTINCT dst AS url FROM links WHERE dst NOT IN (SELECT dst FROM links WHERE page_id % 2 = 0)""",

    "p16_urls_in_text": f"""WITH t AS (
  SELECT page_id, 'see ' || url || ' or (http://x.org/%41?q=ü) "' || url || '/more" https:/no ' || html || printf(' behind: http://h%d.example/p', page_id) AS t FROM pages)
SELECT page_id, unnest(list_distinct(regexp_extract_all(t, {_q(URL_PATTERN)}))) AS url FROM t""",

    "j7_link_depth": f"""WITH RECURSIVE {_links('pages')},
own AS (SELECT page_id, {_canon('url')} AS url FROM pages),
e AS (
  SELECT DISTINCT src, dst FROM links
  UNION SELECT p.url, c.url FROM own c JOIN own p ON c.page_id > 0 AND p.page_id = (c.page_id - 1) // 2),
walk(url, depth) AS (
  SELECT url, 0 FROM own WHERE page_id = 0
  UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.url WHERE w.depth < 3)
SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url""",

    "p10_int_words": f"""WITH {LINES_WORDS.format(src='documents')}
SELECT word, count(*) AS n FROM words WHERE regexp_matches(word, {INTEGER}) GROUP BY word""",

    "p1_content_text": """WITH c AS (
  SELECT doc_id, CASE WHEN doc_id % 10 <> 3 THEN string_split(text, chr(10)) ELSE [''] END AS ps FROM documents),
t AS (SELECT doc_id, list_transform(ps, lambda p: regexp_replace(p, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS ps FROM c)
SELECT doc_id, md5(array_to_string(ps, '')) AS text_md5, md5(array_to_string(ps, ' ')) AS spaced_md5
FROM t WHERE length(array_to_string(ps, '')) > 0""",

    "p3_publish_times": """SELECT event_id,
       CASE WHEN event_id % 11 = 0 THEN '#' WHEN event_id % 13 = 0 THEN '2024-13-01 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time,
       CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN date_trunc('second', ts) END AS pub_ts
FROM events""",

    "p12_depth_cap": f"""WITH {ARTICLES}
SELECT CAST(1 + doc_id % 6 AS INTEGER) AS depth, count(*) AS n FROM articles WHERE doc_id % 6 < 3 GROUP BY 1""",

    "t1_cjk_bigrams": f"""WITH r AS (
  SELECT unnest(regexp_extract_all(lower({HAN}), '\\p{{Han}}+|(?:[^\\p{{Han}}\\P{{L}}]|\\p{{N}})+')) AS run FROM documents),
t AS (
  SELECT unnest(CASE WHEN length(run) > 1 AND regexp_matches(run, '^\\p{{Han}}')
    THEN list_transform(range(1, length(run)), lambda i: substr(run, CAST(i AS INTEGER), 2)) ELSE [run] END) AS term FROM r)
SELECT term, count(*) AS n FROM t WHERE length(term) > 0 GROUP BY term""",

    "t1_dictionary_words": f"""WITH RECURSIVE cr AS (
  SELECT unnest(regexp_extract_all(lower({HAN}), '\\p{{Han}}+')) AS run FROM conversations),
g AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM cr),
grams AS (SELECT substr(run, CAST(i AS INTEGER), CAST(l AS INTEGER)) AS term FROM g, (SELECT unnest([1, 2, 3, 4]) AS l) WHERE i + l - 1 <= length(run)),
counted AS (SELECT term, count(*) AS n FROM grams GROUP BY term HAVING count(*) >= 5),
whole AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM counted),
d AS (SELECT term, CAST(round(ln(n / total) * 1000000) AS BIGINT) AS w FROM counted, whole),
one AS (SELECT CAST(round(ln(1 / total) * 1000000) AS BIGINT) AS w FROM whole),
r AS (SELECT unnest(regexp_extract_all(lower({HAN}), '\\p{{Han}}+|(?:[^\\p{{Han}}\\P{{L}}]|\\p{{N}})+')) AS run FROM documents),
han AS (SELECT DISTINCT run FROM r WHERE regexp_matches(run, '^\\p{{Han}}')),
-- from the end: the best sum from each place on, and the length of the word taken there
dp(run, i, sums, picks) AS (
  SELECT run, length(run), [CAST(0 AS BIGINT)], CAST([] AS BIGINT[]) FROM han
  UNION ALL
  SELECT run, i - 1, list_prepend(b.s, sums), list_prepend(b.l, picks)
  FROM (
    SELECT dp.run, dp.i, sums, picks, list_max(list_filter([
      {{'s': coalesce(d1.w, one.w) + sums[1], 'l': CAST(1 AS BIGINT)}}, {{'s': d2.w + sums[2], 'l': CAST(2 AS BIGINT)}},
      {{'s': d3.w + sums[3], 'l': CAST(3 AS BIGINT)}}, {{'s': d4.w + sums[4], 'l': CAST(4 AS BIGINT)}}], lambda x: x.s IS NOT NULL)) AS b
    FROM dp CROSS JOIN one LEFT JOIN d d1 ON d1.term = substr(run, i, 1)
    LEFT JOIN d d2 ON len(sums) >= 2 AND d2.term = substr(run, i, 2) LEFT JOIN d d3 ON len(sums) >= 3 AND d3.term = substr(run, i, 3)
    LEFT JOIN d d4 ON len(sums) >= 4 AND d4.term = substr(run, i, 4)
    WHERE i > 0)),
walk(run, picks, place, term) AS (
  SELECT run, picks, CAST(1 AS BIGINT), CAST(NULL AS VARCHAR) FROM dp WHERE i = 0
  UNION ALL SELECT run, picks, place + picks[place], substr(run, place, picks[place]) FROM walk WHERE place <= length(run)),
cut AS (SELECT run, term FROM walk WHERE term IS NOT NULL),
t AS (SELECT cut.term FROM r JOIN cut USING (run) UNION ALL SELECT run FROM r WHERE NOT regexp_matches(run, '^\\p{{Han}}'))
SELECT term, count(*) AS n FROM t WHERE length(term) > 0 GROUP BY term""",

    "t4h_hashed_tf": f"""WITH {ARTICLES},
w AS (SELECT doc_id, list_filter({WORDS}, lambda x: length(x) > 0 AND NOT list_contains([{STOP}], x)) AS ws FROM articles)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens FROM w""",

    "p17_day_hour": f"""WITH {ARTICLES}
SELECT doc_id, strftime(pub_ts, '%m-%d') AS day, CAST(hour(pub_ts) AS INTEGER) AS hour,
       printf('%d:00-%d:00', hour(pub_ts), hour(pub_ts) + 1) AS hour_label,
       strftime(pub_ts, '%Y-%m-%d %H:%M') AS minute_key, strftime(pub_ts, '%Y%m%d%H%M') AS file_minute
FROM articles WHERE pub_ts IS NOT NULL""",

    "t2_token_sentences": f"""WITH {ARTICLES},
sw AS (SELECT doc_id, list_filter({WORDS},
                                  lambda x: length(x) > 0 AND NOT list_contains([{STOP}], x)) AS words
       FROM articles)
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, array_to_string(words, ' ') AS sentence FROM sw""",

    "t3_space_tokens": f"""SELECT doc_id,
       CAST(len(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x{{0b}}\\x{{0c}}\\r]'), lambda x: length(x) > 0)) AS INTEGER) AS n_tokens
FROM documents""",

    "r7_last_n": f"""WITH {ARTICLES}
SELECT doc_id, title FROM articles ORDER BY doc_id DESC LIMIT 100""",
}
