"""The registered queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damaged, line_hashes, repair_conversations
from .decontaminate import contaminated
from .hard_negatives import mine_hard_negatives
from .html_main import extract_main_text
from .licences import scan_licences
from .mixing import mix
from .neardup import near_duplicates
from .ngram_join import ngram_join
from .quality import score_quality
from .secrets import find_secrets, joined
from .syncmers import compare_with_next
from .toxicity import score_toxicity
from .url_rules import judge_urls, rule_table

BASE_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark, BASE_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op7_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    return found.select(
        "doc_id",
        F.size(of("assign")).cast("long").alias("n_assign"),
        F.size(of("access")).cast("long").alias("n_access"),
        F.size(of("hex")).cast("long").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"), shingle=5, percent=80)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    reports, repaired = repair_conversations(damaged(rows))
    known = lambda df, name: df.withColumnRenamed("conv_id", name)
    out = rows.select("conv_id").distinct()
    out = out.join(known(reports, "c1"), F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(known(line_hashes(repaired), "c2"), F.col("conv_id").eqNullSafe(F.col("c2")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", wrong))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_url_rules, op3_mixing, op4_licences, op5_toxicity, op6_html_text, op7_syncmers, op8_secrets,
        op9_decontamination, op10_neardup, op11_ngram_join, op12_conversations, op13_hard_negatives,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _links_sql(shingle: int) -> str:
    """Sets (s: doc_id, g) of word shingles, and the least doc_id that each reaches over links of 80% (least_r)."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(generate_series(1, len(w) - {shingle - 1}), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.y, reach.r FROM reach JOIN links l ON l.x = reach.doc_id),
least_r AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
"""


def _repair_sql() -> str:
    """A best path is k, its cost in ten digits and its labels, and t, its lines; four columns hold those of the grammar states."""
    go = lambda v, cost, label, line="''": f"CASE WHEN {v} IS NOT NULL THEN {{'k': lpad(CAST(CAST({v}.k[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || {v}.k[11:] || '{label}', 't': {v}.t || {line}}} END"
    least = lambda *v: f"list_min(list_filter([{', '.join(v)}], lambda x: x IS NOT NULL))"
    new = lambda role: f"'{role}:' || chr(10)"
    kept, user, assistant = "(r.role || ':' || r.text || chr(10))", "('user:' || r.text || chr(10))", "('assistant:' || r.text || chr(10))"
    keep = lambda v, initial: f"CASE WHEN NOT r.doomed AND r.initial = '{initial}' THEN {go(v, 'r.extra', 'K', kept)} END"
    rerole = lambda v, line: f"CASE WHEN NOT r.doomed THEN {go(v, '1 + r.extra', 'R', line)} END"
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::UBIGINT)), lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), list_transform(range(8), lambda i: i::UBIGINT)), lambda b, i: xor(b >> 1, 3988292384::UBIGINT * (b & 1))))"
    return rf"""
WITH RECURSIVE coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor({crc.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")}, 4294967295::UBIGINT) % 20 AS fault
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(CASE WHEN fault = 3 THEN 2 ELSE 1 END) WHERE fault <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         NOT regexp_matches(text, '[^ 	-
]') AS blank,
         NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut, role[1:1] AS initial
  FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM ordered),
r AS (
  SELECT *, blank OR again AS doomed, CASE WHEN cut THEN 5 ELSE 0 END AS extra,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM seen),
stats AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'k': '0000000000', 't': ''}} AS v0, NULL::STRUCT(k VARCHAR, t VARCHAR) AS v1, NULL::STRUCT(k VARCHAR, t VARCHAR) AS v2, NULL::STRUCT(k VARCHAR, t VARCHAR) AS v3 FROM stats
  UNION ALL
  SELECT conv_id, r.i, {go("w.v0", 2, "D")},
         {least(go("w.v1", 2, "D"), keep("w.v0", "s"))},
         {least(go("w.c2", 2, "D"), *(keep(v, "u") for v in ("w.v0", "w.v1", "w.c3")), *(rerole(v, user) for v in ("w.v0", "w.v1", "w.c3")))},
         {least(go("w.c3", 2, "D"), keep("w.c2", "a"), rerole("w.c2", assistant))}
  FROM (SELECT *, {least("v3", go("c2", 5, "I", new("assistant")))} AS c3
        FROM (SELECT *, {least("v2", *(go(v, 5, "I", new("user")) for v in ("v0", "v1", "v3")))} AS c2 FROM walk)) w
  JOIN r USING (conv_id) WHERE r.i = w.i + 1),
ends AS (
  SELECT conv_id, {least("v0", "v3", go("c2", 5, "I", new("assistant")))} AS best
  FROM (SELECT *, {least("v2", *(go(v, 5, "I", new("user")) for v in ("v0", "v1", "v3")))} AS c2 FROM walk JOIN stats USING (conv_id) WHERE i = n))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(best.k[1:10] AS BIGINT), 0) AS cost, coalesce(best.k[11:], '') AS audit, sha256(coalesce(best.t[1:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN stats USING (conv_id) LEFT JOIN ends USING (conv_id)"""


ORACLE_SQL = {
    "op2_url_rules": rf"""
WITH parts AS (
  SELECT page_id,
         {_LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '^([^/]*\.)?(2mdn\.net|adform\.net|adnxs\.com|adsrvr\.org|amazon-adsystem\.com|casalemedia\.com|criteo\.com|doubleclick\.net|googleadservices\.com|googlesyndication\.com|hotjar\.com|moatads\.com|openx\.net|outbrain\.com|popads\.net|pubmatic\.com|quantserve\.com|rubiconproject\.com|scorecardresearch\.com|smartadserver\.com|taboola\.com|zedo\.com)(/|$)') THEN 'block'
    WHEN regexp_matches(host || path, '^([^/]*[.-])?(ads|adserver|adult|bets|betting|casino|escorts|payday|pills|poker|porn|spam|telemetry|tracker|viagra|xxx)[.-]') THEN 'block'
    WHEN regexp_matches(host || path, '/cgi-bin/|/phpmyadmin/|/wp-admin/|/wp-login\.php$|/xmlrpc\.php$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled""",
    "op3_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS k
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM sized GROUP BY source),
weighted AS (SELECT *, CAST((n - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most FROM sums),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER before, 0.0::DOUBLE)) / sum(weight) OVER rest AS level
  FROM weighted
  WINDOW before AS (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY most / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size, CASE WHEN level * weight >= most THEN most ELSE weight * first_value(CASE WHEN level * weight < most THEN level END IGNORE NULLS)
           OVER (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target
  FROM levels),
budgets AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS budget FROM targets),
placed AS (
  SELECT d.*, b.source_size, b.target, b.budget, CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM placed""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
ig AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(generate_series(1, len(w) - least(len(w), 5) + 1), lambda p: array_to_string(w[p:p + least(len(w), 5) - 1], ' '))) AS g
  FROM i WHERE len(w) > 0),
sized AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n_shingles FROM ig),
dg AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g
  FROM d, (SELECT DISTINCT k FROM ig) WHERE len(w) >= k)
SELECT doc_id, item_id, CAST(n_shingles AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_shared, count(*) / n_shingles AS containment
FROM dg JOIN sized USING (k, g) GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8""",
    "op10_neardup": _links_sql(2) + "SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least_r USING (doc_id)",
    "op11_ngram_join": _links_sql(5) + "SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN least_r USING (doc_id)",
    "op12_conversations": _repair_sql(),
    "op13_hard_negatives": r"""
WITH known AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM known),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(sum(a.v * b.v) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.i = b.i WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id, a.label, b.label),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
met AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM scores JOIN positives USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
