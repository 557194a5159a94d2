"""The queries of this folder, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from weftlog.llm import decontaminate, language_id, license_scan, mixing, near_dup, quality_model, quality_rules, sharding, token_counts, url_filter
from weftlog.llm.common import table
from pyspark.sql import functions as F


def op1_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.labelled(spark))


def op2_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


def op3_quality_model(spark, sf_dir):
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark, sf_dir):
    return language_id.predict(table(spark, sf_dir, "documents"))


def op5_near_dup(spark, sf_dir):
    return near_dup.group(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark, sf_dir):
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", *quality_rules.MEASURES, (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes().alias("kept"), F.col("failed").cast("long").alias("failed"))


def quality_rule_ablation(spark, sf_dir):
    """What each rule of the current policy rejects, alone and with others, from the ledger's bits."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents"), []))


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_token_counts(spark, sf_dir):
    return token_counts.counts(table(spark, sf_dir, "documents"))


def op9_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def license_sql(templates=license_scan.TEMPLATES, containment: float = license_scan.CONTAINMENT) -> str:
    """The scan by plain windows: for each template, the most distinct words that any of its blocks holds."""
    rows = []
    for i, (label, sentence) in enumerate(templates):
        t = license_scan.prepare([(label, sentence)], {}, containment)[0]
        rows.append(f"({i}, '{label}', {t.need}, {t.size}, {t.length}, [{', '.join(repr(w.decode()) for w in t.rank)}])")
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in license_scan.PHRASES)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
x AS (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) - 1 AS i FROM w),
g AS (SELECT r, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c, lead(a, 3) OVER p AS d FROM x WINDOW p AS (PARTITION BY r ORDER BY i)),
ph AS (SELECT * FROM (VALUES {phrases}) v(label, p)),
base AS (SELECT r, i, label FROM g JOIN ph ON a = p[1] AND b = p[2] AND c = p[3] AND (len(p) = 3 OR d = p[4])),
t AS (SELECT * FROM (VALUES {', '.join(rows)}) v(t, label, need, size, length, words)),
e AS (SELECT DISTINCT x.r, x.i, x.a, t.t FROM (SELECT t, unnest(words) AS a FROM t) t JOIN x ON x.a = t.a),
en AS (SELECT r, e.t FROM e JOIN t ON e.t = t.t GROUP BY r, e.t, need HAVING count(DISTINCT a) >= need),
held AS (SELECT e.r, e.t, count(DISTINCT f.a) AS n FROM en JOIN e ON e.r = en.r AND e.t = en.t JOIN t ON t.t = e.t
  JOIN e f ON f.r = e.r AND f.t = e.t AND f.i BETWEEN e.i AND e.i + t.length - 1 GROUP BY e.r, e.t, e.i),
met AS (SELECT r, label, max(n::DOUBLE / size) AS c FROM held JOIN t ON held.t = t.t WHERE n >= need GROUP BY r, label),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM met UNION SELECT r, label FROM base) GROUP BY r),
m AS (SELECT r, max(c) AS c FROM met GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN b ON w.r = b.r LEFT JOIN l ON w.r = l.r LEFT JOIN m ON w.r = m.r"""


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_sharding, op3_quality_model, op4_language_id, op5_near_dup, op6_quality_rules, op7_mixing, op8_token_counts, op9_license_scan, op10_decontaminate, quality_rule_ablation)}
ORACLES: dict[str, str] = {
    "op9_license_scan": license_sql(),
    "op6_quality_rules": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, a, lead(a, 1) OVER p AS b, lead(a, 2) OVER p AS c FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN l ON w.doc_id = l.doc_id LEFT JOIN covered ON w.doc_id = covered.doc_id),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (word_chars < 2 * n_words)::INT
  + 16 * (word_chars > 20 * n_words)::INT + 32 * (n_dup_lines > 20 AND 4 * n_dup_lines > n_words)::INT AS BIGINT) AS failed FROM m)
SELECT *, failed & 3 <> 0 AS base_failed, failed = 0 AS kept FROM f""",
}
BITS = ", ".join(f"('{name}', {bit})" for name, bit in quality_rules.BIT.items())
ORACLES["quality_rule_ablation"] = ORACLES["op6_quality_rules"].rpartition("SELECT *")[0] + f"""SELECT rule, count(*) FILTER (WHERE failed & bit <> 0) AS n_failed,
  count(*) FILTER (WHERE failed = bit) AS n_only, count(*) FILTER (WHERE failed & ({sum(quality_rules.BIT.values())} - bit) = 0) AS n_kept_without FROM f CROSS JOIN (VALUES {BITS}) r(rule, bit) GROUP BY rule"""
