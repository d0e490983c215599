"""The subpackage's queries, one for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import (
    exact_dedup,
    html_extract,
    jaccard_join,
    language_id,
    mixing,
    packing,
    secret_scan,
    token_counts,
    topk_search,
    url_filter,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return topk_search.search_top_k(spark, vectors, vectors.where("vec_id % 100 = 0"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(spark, _read(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(spark, _read(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "decided_by")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(spark, _read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
        secret_scan.joined(F.col("found")).alias("spans"), "n_live", "n_example",
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(spark, _read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.train_and_identify(spark, _read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return exact_dedup.dedup_batch(docs, exact_dedup.fresh_index(spark, docs=docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(spark, _read(spark, sf_dir, "documents"))
    return mixed.withColumn("mix_rate", F.round("mix_rate", 6))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(token_counts.length_counts(_read(spark, sf_dir, "documents"), extra=1))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_search,
        op2_html_extract,
        op3_url_filter,
        op4_secret_scan,
        op5_packing,
        op6_jaccard_join,
        op7_language_id,
        op8_exact_dedup,
        op9_mixing,
        op10_token_counts,
    )
}

_OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10"""


def _rule_sql(host: str, path: str, column: int) -> str:
    fits = [
        f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[column]}'"
        for h, p, v in sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    return "CASE " + " ".join(fits) + " END"


_HOST = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _plain_sql(path: str) -> str:
    step = "lambda p, q: CASE WHEN q[1] = '..' THEN p[1:greatest(len(p) - 1, 1)] WHEN q[1] = '.' THEN p ELSE list_concat(p, q) END"
    return f"CASE WHEN regexp_matches({path}, '{url_filter._DOTS}') THEN array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), {step}), '/') ELSE {path} END"


def _key_sql(url: str) -> str:
    return f"{_HOST.format(url)} || regexp_replace({_plain_sql(_PATH.format(url))}, '/+$', '') || regexp_extract({url}, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]+)', 1)"


def _resolve_sql(base: str, ref: str) -> str:
    origin, folder = f"regexp_extract({base}, '(?s)^(.*?://[^/?#]*)', 1)", f"regexp_extract({_PATH.format(base)}, '(?s)^(.*/)', 1)"
    return (
        f"CASE WHEN {ref} = '' THEN NULL WHEN regexp_matches({ref}, '{url_filter._SCHEME}') THEN CASE WHEN regexp_matches({ref}, '{url_filter._ABSOLUTE}') THEN {ref} END "
        f"WHEN starts_with({ref}, '//') THEN 'http:' || {ref} WHEN starts_with({ref}, '/') THEN {origin} || {ref} WHEN starts_with({ref}, '?') THEN {origin} || {_PATH.format(base)} || {ref} "
        f"ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {ref} END"
    )


def _value_sql(tag: str, name: str) -> str:
    pattern = url_filter._VALUE.format(name).replace("'", "''")
    return "(" + " || ".join(f"regexp_extract({tag}, '{pattern}', {i})" for i in (1, 2, 3)) + ")"


def _tags_sql(pattern: str, only: str) -> str:
    return f"list_filter(regexp_extract_all(html, '{pattern}'), lambda x: regexp_matches(x, '{only}'))".replace("x, '" + only, "x, '" + only.replace("'", "''"))


_REF = "trim(regexp_replace(regexp_replace({0}, '(?s)#.*$', ''), '&(amp|#38|#[xX]26);', '&', 'g'))"
_OP3 = rf"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, regexp_replace(coalesce(html, ''), '{url_filter._COMMENT}', '', 'g') AS html FROM pages),
h AS (SELECT page_id, url, html, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_key_sql('url')} AS key FROM u),
l AS (SELECT key AS a, url, {_REF.format("coalesce(list_transform(regexp_extract_all(html, '" + url_filter._BASE + "'), lambda x: " + _value_sql('x', 'href') + ")[1], '')")} AS base,
  unnest(list_concat(list_transform({_tags_sql(url_filter._LINK, url_filter._IS_CANONICAL)}, lambda x: {_value_sql('x', 'href')}),
    list_transform({_tags_sql(url_filter._META, url_filter._IS_REFRESH)}, lambda x: regexp_extract({_value_sql('x', 'content')}, '{url_filter._REFRESH_TO.replace("'", "''")}', 1)))) AS ref FROM h WHERE contains(url, '://')),
l2 AS (SELECT a, coalesce({_resolve_sql('url', 'base')}, url) AS base, {_REF.format('ref')} AS ref FROM l),
t AS (SELECT a, {_resolve_sql('base', 'ref')} AS l FROM l2),
e AS (SELECT a, {_key_sql('l')} AS b FROM t WHERE l IS NOT NULL), ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, root) AS (SELECT a, a FROM ee UNION SELECT ee.b, reach.root FROM reach JOIN ee ON ee.a = reach.a),
comp AS (SELECT a AS key, min(root) AS root FROM reach GROUP BY a),
kv AS (SELECT key, root, regexp_extract(key, '(?s)^([^/?]*)', 1) AS kh, regexp_extract(key, '(?s)^[^/?]*([^?]*)', 1) AS kp FROM comp),
judged AS (SELECT root, coalesce({_rule_sql('kh', 'kp', 1)}, {_rule_sql('kh', "(kp || '/')", 1)}) AS v FROM kv),
best AS (SELECT root, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM judged GROUP BY root),
r AS (SELECT page_id, host, path, key, {_rule_sql('host', 'path', 0)} AS rule, {_rule_sql('host', 'path', 1)} AS verdict FROM h)
SELECT page_id, host, path, rule, coalesce(r.verdict, best.v, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'rule' WHEN best.v IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM r LEFT JOIN comp USING (key) LEFT JOIN best USING (root)"""

_ANY_CASE = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN_SQL = _ANY_CASE + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches_sql(kind: str, pattern: str, group: int) -> str:
    return (
        f"SELECT rid, '{kind}' AS kind, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS whole, unnest(v) AS val, unnest(list_slice(g, 1, len(w))) AS gap FROM "
        f"(SELECT rid, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g FROM d)"
    )


_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0)) AS own, coalesce(CAST(doc_id AS VARCHAR), chr(0)) AS repo FROM documents),
m AS ({_matches_sql('assign', _ASSIGN_SQL, 2)} UNION ALL {_matches_sql('access', secret_scan.ACCESS, 0)} UNION ALL {_matches_sql('hex', secret_scan.HEX, 0)} UNION ALL {_matches_sql('owned', secret_scan.BARE, 0)}),
s AS (SELECT *, CAST(sum(length(gap) + length(whole)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS stop FROM m),
p AS (SELECT rid, kind, stop - length(whole) AS start, stop, val FROM s),
base AS (SELECT * FROM p WHERE kind <> 'owned' AND (kind <> 'assign' OR length(val) >= {secret_scan.ASSIGN_MIN})),
bare AS (SELECT * FROM p WHERE kind = 'owned' AND length(regexp_replace(val, '[^A-Za-z]', '', 'g')) >= 4 AND length(regexp_replace(val, '[^0-9]', '', 'g')) >= 4
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = p.rid AND b.start < p.stop AND p.start < b.stop)),
c AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
o AS (SELECT val, count(DISTINCT own) AS owners, count(DISTINCT repo) AS repos FROM c JOIN d USING (rid) GROUP BY val),
j AS (SELECT c.*, owners < 3 AND repos < 10 AS live, CASE kind WHEN 'assign' THEN 1 WHEN 'access' THEN 2 WHEN 'hex' THEN 3 ELSE 4 END AS k FROM c JOIN o USING (val)),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) FILTER (k < 4) AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k, stop) FILTER (k < 4 OR live) AS al,
  count(*) FILTER (k < 4 AND live) AS n_live, count(*) FILTER (k < 4 AND NOT live) AS n_example FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(al, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN a USING (rid)"""

_OP8 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w"""

_OP9 = """
WITH s AS (SELECT source, count(*) AS n, sqrt(count(*)) AS share FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s) * share / (SELECT sum(share) FROM s) / n AS m FROM s),
k AS (SELECT source, m, unnest(range(0, CAST(ceil(m + 12 * sqrt(m) + 24) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, m, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
d AS (SELECT *, CAST('0x' || left(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':1'), 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
t AS (SELECT d.*, m, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u) AS times FROM d JOIN r ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, text, lang, source, n_chars, round(m, 6) AS mix_rate, CAST(replica AS INT) AS replica, md5(concat_ws(':', 'order17', doc_id, replica)) AS shuffle_key
FROM (SELECT *, unnest(range(1, times + 1)) AS replica FROM t)"""

#: The others need a tokenizer, an HTML parser, profiles or similarities, and are tested against brute force.
ORACLES: dict[str, str] = {"op1_topk_search": _OP1, "op3_url_filter": _OP3, "op4_secret_scan": _OP4, "op8_exact_dedup": _OP8, "op9_mixing": _OP9}
