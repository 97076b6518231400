"""The queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, embedding_dedup, kneser_ney, language_id, minhash_dedup, mixing, substring_dedup, token_counts, url_filter, warc_revisit
from lodestone.llm.common import crc_of, small_batches

#: Target weights of the mix by source; sources not named share the weight 1.
WEIGHTS = {"src0": 5} | {f"src{i}": 3 for i in range(1, 10)} | {f"src{i}": 2 for i in range(10, 20)}
BLOCK = 16
#: Rank file of a public tokenizer; every worker can read it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_spans(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_warc_revisit(spark, sf_dir):
    out = warc_revisit.resolve_revisits(warc_revisit.page_records(_read(spark, sf_dir, "pages")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select(((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), "canonical_url", (F.col("refers_to") / 2).cast("long").cast("string").alias("refers_to"), "outcome", F.array_join(pairs, ";").alias("headers"), "digest")


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_url_filter(spark, sf_dir):
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op5_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), VOCABULARY)


def op7_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = language_id.train(docs, crc_of("doc_id") % 3 != 1)
    out = language_id.identify(docs, model)
    return out.select("doc_id", (crc_of("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_decontamination(spark, sf_dir):
    return decontaminate.judge_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_source_mixing(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix_sources(docs, WEIGHTS, BLOCK)


def op10_lm_scoring(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    model = kneser_ney.train(docs, crc_of("doc_id") % 10 != 0)
    out = kneser_ney.score_documents(docs, model)
    rounded = (F.round(c, places).alias(c) for c, places in (("base_score", 6), ("score", 6), ("perplexity", 3)))
    return out.select("doc_id", (crc_of("doc_id") % 10 == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", *rounded)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_warc_revisit, op3_embedding_dedup, op4_url_filter, op5_minhash_dedup, op6_token_counts, op7_language_id, op8_decontamination, op9_source_mixing, op10_lm_scoring)
}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[ \x09-\x0D]+'), lambda x: x <> '')"

OP1 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE win.doc_id > m) GROUP BY doc_id),
marked AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM marked WHERE len(ps) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM marked) g USING (doc_id, p) GROUP BY doc_id)
SELECT marked.doc_id, len(w)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed,
  sha256(CASE WHEN len(ps) = 0 THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM marked LEFT JOIN kept USING (doc_id)
"""

_CANONICAL = r"""regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*[?](.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))), '&'), ''), '')"""

OP2 = rf"""
WITH top AS (SELECT coalesce(max(page_id), 0) AS top FROM pages),
base AS (SELECT page_id, '"' || md5(coalesce(html, '')) || '"' AS etag, sha1(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n, {_CANONICAL} AS url
  FROM (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages)),
response AS (SELECT page_id, url, n, CASE WHEN page_id % 7 <> 3 THEN etag END AS etag, CASE WHEN page_id % 7 <> 3 THEN digest END AS digest FROM base WHERE page_id % 11 <> 5),
revisit AS (SELECT *, page_id * 2 + 1 + (top // 2) * 2 AS ts FROM base, top),
met AS (SELECT r.page_id, r.url, r.etag, r.digest, r.ts, o.page_id AS old, o.etag AS old_etag, o.digest AS old_digest, o.n AS old_n
  FROM revisit r ASOF LEFT JOIN response o ON r.url = o.url AND r.ts > o.page_id * 2)
SELECT page_id, url AS canonical_url, old::VARCHAR AS refers_to, outcome, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN
  'content-length=' || old_n || ';content-type=text/html;date=' || ts || ';etag=' || etag END AS headers, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN old_digest END AS digest
FROM (SELECT *, CASE WHEN old IS NULL THEN 'missing' WHEN old_etag IS NULL THEN 'unvalidated' WHEN etag = old_etag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM met)
"""

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.m, vec_id)) AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP4 = f"""
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, {_ASCII_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES {", ".join(repr(r) for r in url_filter.RULES)}),
fit AS (SELECT page_id, arg_max(h || p, len(string_split(h, '.')) * 100000 + len(p)) AS rule, arg_max(verdict, len(string_split(h, '.')) * 100000 + len(p)) AS verdict
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fit USING (page_id)
"""

OP5 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_ASCII_LOWER.format('text'))} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low.m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low.m, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = doc_id
"""

_ALL = WEIGHTS | {"\u0000other": 1}
_TOTAL = sum(_ALL.values())
_SOURCES = sorted(_ALL)
OP9 = f"""
WITH RECURSIVE src(i, name, a) AS (VALUES {", ".join(f"({i}, '{'other' if n[0] == chr(0) else n}', {_ALL[n]})" for i, n in enumerate(_SOURCES))}),
run(t, done, pick) AS (
  SELECT -1, list_transform(range({len(_SOURCES)}), lambda x: 0), -1
  UNION ALL
  SELECT t + 1, list_transform(done, lambda d, j: d + CASE WHEN j = p + 1 THEN 1 ELSE 0 END), p
  FROM (SELECT t, done, (SELECT arg_min(i, ((done[i + 1] + 1) * {_TOTAL} + a - 1) // a * 1000 + i) FROM src WHERE (done[i + 1] * {_TOTAL}) // a <= t + 1 AND done[i + 1] < a) AS p FROM run WHERE t < {_TOTAL - 1})),
sched AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY t) - 1 AS k, t AS slot FROM run JOIN src ON i = pick WHERE pick >= 0),
rows AS (SELECT doc_id, source, CASE WHEN source IN (SELECT name FROM src WHERE name <> 'other') THEN source ELSE 'other' END AS name FROM documents),
nums AS (SELECT doc_id, source, name, row_number() OVER (PARTITION BY name ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rn FROM rows),
placed AS (SELECT doc_id, source, rn // {BLOCK} // a * {_TOTAL} + slot AS mix_slot, rn % {BLOCK} AS mix_place FROM nums JOIN src USING (name) JOIN sched ON sched.name = nums.name AND k = rn // {BLOCK} % a),
stop AS (SELECT min(c // {BLOCK} // a * {_TOTAL} + slot) AS stop FROM (SELECT name, count(*) AS c FROM rows GROUP BY name) e JOIN src USING (name) JOIN sched ON sched.name = e.name AND k = c // {BLOCK} % a)
SELECT doc_id, source, mix_slot::BIGINT AS mix_slot, mix_place::BIGINT AS mix_place, coalesce(mix_slot < stop, false) AS mix_within FROM placed, stop
"""

#: crc32 of an id as text, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
  lambda h, b: list_reduce(list_prepend(xor(h, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

# the end of a text is a line feed, its beginning a blank; neither occurs in a word
OP10 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_CRC32.format("doc_id")} % 10 = 0 AS held_out, list_append({_WORDS.format(_ASCII_LOWER.format("text"))}, chr(10)) AS w FROM documents),
t AS MATERIALIZED (SELECT r, held_out, CASE WHEN i = 2 THEN ' ' WHEN i > 2 THEN w[i - 2] END AS a, CASE WHEN i = 1 THEN ' ' ELSE w[i - 1] END AS b, w[i] AS c FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
seen AS (SELECT c, count(*) AS n FROM t WHERE NOT held_out GROUP BY c), all_seen AS (SELECT sum(n)::BIGINT AS n, count(*) AS v FROM seen),
c3 AS MATERIALIZED (SELECT a, b, c, count(*) AS n FROM t WHERE NOT held_out AND a IS NOT NULL GROUP BY ALL),
c2 AS MATERIALIZED (SELECT b, c, count(*) AS n FROM c3 GROUP BY ALL UNION ALL SELECT b, c, count(*) FROM t WHERE NOT held_out AND b = ' ' GROUP BY ALL),
c1 AS MATERIALIZED (SELECT c, count(*) AS n FROM c2 GROUP BY c),
k AS (SELECT o, count(*) FILTER (n = 1) AS a, count(*) FILTER (n = 2) AS b, count(*) FILTER (n = 3) AS c, count(*) FILTER (n = 4) AS d FROM (SELECT 1 AS o, n FROM c1 UNION ALL SELECT 2, n FROM c2 UNION ALL SELECT 3, n FROM c3) GROUP BY o),
d0 AS (SELECT o, a > 0 AND b > 0 AND c > 0 AS sound, a / (a + 2 * b) AS y, a, b, c, d FROM k),
dis AS MATERIALIZED (SELECT o, [CASE WHEN sound THEN least(greatest(1 - 2 * y * b / a, 0), 1) ELSE 0.5 END, CASE WHEN sound THEN least(greatest(2 - 3 * y * c / b, 0), 2) ELSE 0.5 END, CASE WHEN sound THEN least(greatest(3 - 4 * y * d / c, 0), 3) ELSE 0.5 END] AS d FROM d0),
x3 AS (SELECT a, b, sum(n) AS total, sum(d[least(n, 3)]) AS mass FROM c3, dis WHERE o = 3 GROUP BY a, b),
x2 AS (SELECT b, sum(n) AS total, sum(d[least(n, 3)]) AS mass FROM c2, dis WHERE o = 2 GROUP BY b),
x1 AS (SELECT sum(n) AS total, sum(d[least(n, 3)]) AS mass FROM c1, dis WHERE o = 1),
p1 AS MATERIALIZED (SELECT t.r, t.a, t.b, t.c, seen.n AS n, coalesce(greatest(c1.n - d[least(c1.n, 3)], 0), 0) / x1.total + x1.mass / x1.total / (v + 1) AS p
  FROM t CROSS JOIN all_seen CROSS JOIN x1 CROSS JOIN (SELECT d FROM dis WHERE o = 1) LEFT JOIN c1 ON c1.c = t.c LEFT JOIN seen ON seen.c = t.c),
p2 AS MATERIALIZED (SELECT p1.r, p1.a, p1.b, p1.c, p1.n, CASE WHEN total > 0 THEN coalesce(greatest(c2.n - d[least(c2.n, 3)], 0), 0) / total + mass / total * p ELSE p END AS p
  FROM p1 CROSS JOIN (SELECT d FROM dis WHERE o = 2) LEFT JOIN x2 ON x2.b = p1.b LEFT JOIN c2 ON c2.b = p1.b AND c2.c = p1.c),
p3 AS (SELECT p2.r, p2.n, CASE WHEN total > 0 THEN coalesce(greatest(c3.n - d[least(c3.n, 3)], 0), 0) / total + mass / total * p ELSE p END AS p
  FROM p2 CROSS JOIN (SELECT d FROM dis WHERE o = 3) LEFT JOIN x3 ON x3.a = p2.a AND x3.b = p2.b LEFT JOIN c3 ON c3.a = p2.a AND c3.b = p2.b AND c3.c = p2.c),
s AS (SELECT r, count(*) AS n_tokens, count(p3.n) AS n_known, any_value(all_seen.n) AS train_tokens, fsum(log10((coalesce(p3.n, 0) + 0.1) / (all_seen.n + 0.1 * (v + 1)))) AS base, fsum(log10(p)) AS score FROM p3, all_seen GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base, 6) AS base_score, round(score, 6) AS score, round(pow(10, -score / n_tokens), 3) AS perplexity FROM d JOIN s USING (r)
"""

ORACLES = {"op1_substring_dedup": OP1, "op2_warc_revisit": OP2, "op3_embedding_dedup": OP3, "op4_url_filter": OP4, "op5_minhash_dedup": OP5, "op9_source_mixing": OP9, "op10_lm_scoring": OP10}
