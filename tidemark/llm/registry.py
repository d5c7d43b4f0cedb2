"""The registered queries of the text operators and, where it can say them, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import chat, decontam, langid, media, mixture, pii, quality, simhash, suffix, urls


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_table(spark, d, "documents"))


def op2_language(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return langid.predict(docs, langid.learn(langid.training_rows(docs))).drop("spans")


def op3_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return quality.predict(docs, quality.learn(docs, _table(spark, d, "labels")))


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontam.digests(decontam.find(_table(spark, d, "documents"), _table(spark, d, "benchmark")))


def op5_media(spark: SparkSession, d: str) -> DataFrame:
    return media.digests(media.sniff(media.store_texts(_table(spark, d, "documents"))))


def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = _table(spark, d, "pages")
    out = urls.judge(pages, urls.page_outcomes(pages, _table(spark, d, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix.digests(suffix.dedup(_table(spark, d, "documents")))


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.digests(simhash.near_duplicates(_table(spark, d, "documents")))


def op9_chat(spark: SparkSession, d: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(turns))


def op10_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digests(pii.find(_table(spark, d, "documents")))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
m AS (SELECT s.r, s.i, p.k, p.item_id FROM s JOIN p ON s.t = p.t AND s.k = p.k),
h AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
x AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(x.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN x USING (r)"""

#: Each level's rate follows from its counts and the level above; a page takes the first of host, domain, suffix and all pages that has an outcome.
_OP6 = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(rh, rp, rule, rv) AS (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
u AS (SELECT host, rtrim(regexp_replace(string_split(host, '@')[-1], ':[0-9]*$', ''), '.') AS name FROM (SELECT DISTINCT host FROM p)),
t AS (SELECT *, string_split(name, '.') AS l, regexp_full_match(name, '[0-9]{1,3}(\.[0-9]{1,3}){3}') OR starts_with(name, '[') AS ip FROM u),
g AS (SELECT *, CASE WHEN len(l) > 1 AND regexp_full_match(l[-1], '[a-z][a-z]') AND l[-2] IN ('ac','co','com','edu','gob','gov','go','mil','ne','net','nom','or','org','sch') THEN 2 ELSE 1 END AS k FROM t),
n AS (SELECT host, CASE WHEN ip THEN name ELSE array_to_string(l[-(k + 1):], '.') END AS domain, CASE WHEN ip THEN 'ip' ELSE array_to_string(l[-k:], '.') END AS suffix FROM g),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS b FROM p JOIN n USING (host) JOIN l ON page_id = doc_id GROUP BY ALL),
a AS (SELECT sum(n) AS n, (sum(b) + 1) / (sum(n) + 2) AS r, 20e0 AS m FROM h HAVING count(*) > 0),
s0 AS (SELECT suffix, sum(h.n) AS n, sum(b) AS b, any_value(a.r) AS up FROM h, a GROUP BY suffix),
s1 AS (SELECT coalesce(least(1000, greatest(1, 1 / greatest((sum(n * (b / n - up) ** 2 / (up * (1 - up))) - count(*)) / nullif(sum(n - 1), 0), 1e-9) - 1)), 20) AS m FROM s0),
s AS (SELECT suffix, n, m, (b + m * up) / (n + m) AS r FROM s0, s1),
d0 AS (SELECT domain, sum(h.n) AS n, sum(b) AS b, any_value(s.r) AS up FROM h JOIN s USING (suffix) GROUP BY domain),
d1 AS (SELECT coalesce(least(1000, greatest(1, 1 / greatest((sum(n * (b / n - up) ** 2 / (up * (1 - up))) - count(*)) / nullif(sum(n - 1), 0), 1e-9) - 1)), 20) AS m FROM d0),
d AS (SELECT domain, n, m, (b + m * up) / (n + m) AS r FROM d0, d1),
h0 AS (SELECT host, h.n, h.b, d.r AS up FROM h JOIN d USING (domain)),
h1 AS (SELECT coalesce(least(1000, greatest(1, 1 / greatest((sum(n * (b / n - up) ** 2 / (up * (1 - up))) - count(*)) / nullif(sum(n - 1), 0), 1e-9) - 1)), 20) AS m FROM h0),
q AS (SELECT host, n, m, (b + m * up) / (n + m) AS r FROM h0, h1),
x AS (SELECT n.host, CASE WHEN q.r IS NOT NULL THEN [q.n, q.m, q.r] WHEN d.r IS NOT NULL THEN [d.n, d.m, d.r] WHEN s.r IS NOT NULL THEN [s.n, s.m, s.r] ELSE (SELECT [n, m, r] FROM a) END AS v
FROM n LEFT JOIN q USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix)),
f AS (SELECT page_id, rule, rv FROM (SELECT DISTINCT * FROM p) JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rv, CASE WHEN v[3] - 1.645e0 * sqrt(v[3] * (1 - v[3]) / (v[1] + v[2] + 1)) > 0.5e0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id) JOIN x ON p.host = x.host"""

_ESC = "replace(replace(replace(replace(replace({0}, '␛', '␛␛'), '<s>', '<␛s>'), '[INST]', '[␛INST]'), '[/INST]', '[␛/INST]'), '</s>', '<␛/s>')"
_OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
3 + sum(length({_ESC.format('text')}) + CASE WHEN before = role THEN 7 ELSE 13 + length({_ESC.format('role')}) END + CASE WHEN after = role THEN 0 ELSE 4 END) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM f"""

QUERIES = {
    "op1_mixture": (op1_mixture, None),
    "op2_language": (op2_language, None),
    "op3_quality": (op3_quality, None),
    "op4_decontamination": (op4_decontamination, _OP4),
    "op5_media": (op5_media, None),
    "op6_url_filter": (op6_url_filter, _OP6),
    "op7_suffix_dedup": (op7_suffix_dedup, None),
    "op8_simhash": (op8_simhash, None),
    "op9_chat": (op9_chat, _OP9),
    "op10_pii": (op10_pii, None),
    "pipeline": (pipeline, None),
}
