"""Queries over texts. Patterns that DuckDB's engine can express have SQL; the others are held against golden vectors in tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import review
from ..sources.adapters import PROMPTS, prompts, table
from .queries import query

#: Secrets appended to texts by id, so that every kind occurs.
PLANTED = [
    "", " Authorization: Basic abc123==", " see https://user:pw@example.org/x", " key sk-ant-" + "a1" * 12, " key sk-" + "b2" * 12, " ghp_" + "c" * 36, " AKIA" + "D" * 16, " xoxb-1-2", " eyJa.b.c", ' password: "hunter2"',
]


def secret_texts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, PLANTED)), (F.col("doc_id") % 10 + 1).cast("int"))).alias("text"))


@query("c1_redact")
def c1(spark, d):
    rows = secret_texts(spark, d).select("doc_id", text.redaction(F.col("text")).alias("r"))
    return rows.select("doc_id", F.sha2("r.text", 256).alias("scrubbed_sha256"), F.to_json(text.counts_map(F.col("r"))).alias("counts"))


def _sql_families() -> str:
    parts = []
    for family, phrases in text.CORRECTIONS.items():
        where = f"text[1:{text.HEAD}]" if family == text.HEAD_ONLY else "text"
        pattern = "|".join(f"(?:{p})" for p in phrases).replace("'", "''")
        parts.append(f"CASE WHEN regexp_matches({where}, '(?i){pattern}') THEN '{family}' END")
    return "array_to_string(list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL), ',')"


@query("c7_correction_families", f"WITH {PROMPTS} SELECT session, idx, {_sql_families()} AS families FROM prompts")
def c7(spark, d):
    return prompts(spark, d).select("session", "idx", F.array_join(text.correction_families(F.col("text")), ",").alias("families"))


@query("c8_synthetic_reason")
def c8(spark, d):
    return prompts(spark, d).select("session", "idx", text.synthetic_reason(F.col("text")).alias("reason"))


@query("c9_gate")
def c9(spark, d):
    rows = prompts(spark, d).withColumn("s", text.gate_signals(F.col("text")))
    tier, reasons = text.gate_tier(F.col("s"), F.lit(False))
    return rows.select("session", "idx", tier.alias("tier"), F.array_join(reasons, "; ").alias("reasons"), F.to_json("s").alias("signals"))


@query("c21_verbs_and_files", f"""WITH {PROMPTS} SELECT session, idx, array_to_string(list_filter([{', '.join("CASE WHEN regexp_matches(text, '(?i)" + "(?:^|[^\\p{L}\\p{N}_])" + v + "') THEN '" + v + "' END" for v in text.VERBS)}], lambda x: x IS NOT NULL), ',') AS verbs,
    len(list_filter(list_transform(regexp_extract_all(text, '[^\\s,;:()\\[\\]{{}}''"`]+'), lambda t: trim(t, '.,;:!?')), lambda t: contains(t, '/') OR regexp_matches(t, '\\.[A-Za-z]{{1,6}}$'))) AS file_refs FROM prompts""")
def c21(spark, d):
    return prompts(spark, d).select("session", "idx", F.array_join(text.prompt_verbs(F.col("text")), ",").alias("verbs"), text.count_file_refs(F.col("text")).alias("file_refs"))


@query("c22_word_ngrams", f"""WITH {PROMPTS}, w AS (SELECT session, idx, list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: contains(x, '-') OR regexp_matches(x, '^\\p{{L}}+$')) AS w FROM prompts),
    g AS (SELECT session, idx, unnest(list_distinct(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS gram FROM w)
    SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 2""")
def c22(spark, d):
    grams = prompts(spark, d).select(F.explode(text.word_ngrams(F.col("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n >= 2")


@query("c14_clip", r"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE CASE WHEN regexp_extract(t[1:80], '^(.*) ', 1) = '' THEN t[1:80] ELSE regexp_extract(t[1:80], '^(.*) ', 1) END || '…' END AS clipped FROM t""")
def c14(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clip(F.coalesce("text", F.lit("")), 80).alias("clipped"))


@query("c16_normalize_remote", r"""WITH u AS (SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/o' || (page_id % 7) || '/r' || (page_id % 30) || CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '' END AS remote FROM pages)
    SELECT page_id, 'o' || (page_id % 7) || '/r' || (page_id % 30) AS repo FROM u""")
def c16(spark, d):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    remote = F.concat(F.lit("https://"), host, F.lit("/o"), F.col("page_id") % 7, F.lit("/r"), F.col("page_id") % 30, F.when(F.col("page_id") % 2 == 0, ".git").otherwise(""))
    return table(spark, d, "pages").select("page_id", text.normalize_remote(remote).alias("repo"))


ALLOW, DENY = ["en/**", "de/**/1*"], ["*/9*", "fr/*?*"]


@query("f14_path_policy", r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(path, '^.*/9.*$') THEN 'denied:*/9*' WHEN regexp_matches(path, '^fr/.*..*$') THEN 'denied:fr/*?*' WHEN regexp_matches(path, '^en/.*$') THEN 'allowed:en/**'
        WHEN regexp_matches(path, '^de(/|/.*/)1.*$') THEN 'allowed:de/**/1*' ELSE 'not_in_allowlist' END AS reason FROM p""")
def f14(spark, d):
    paths = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"))
    return review.path_policy(paths, ALLOW, DENY).select("page_id", "reason")


@query("d2_hour_bucket", "SELECT event_id, CAST(floor(hour(ts) / 6) AS BIGINT) AS bucket FROM events")
def d2(spark, d):
    return table(spark, d, "events").select("event_id", scalars.hour_bucket(F.unix_millis(F.col("ts").cast("timestamp"))).alias("bucket"))


@query("d7_row_hash", """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS row_hash FROM orders""")
def d7(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalars.row_hash(o, "o_orderkey", "o_custkey", "o_orderstatus").alias("row_hash"))
