"""Generated text: hygiene of today's version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import hygiene as H
from ..functions.normalize import once
from ..session import load, spread
from .query import Query
from .sqltext import BLANK as _SP, NO_ISSUE_SQL as _NO_ISSUE_SQL, SQUEEZE_SQL as _SQUEEZE, STRIP_SQL as _STRIP

_ROLE_SQL = "(?im)^[ \\t]*(?:assistant|user|system)[ \\t]*:?[ \\t]*$"
_QUOTE = lambda s: s.replace("'", "''")

CLEAN_SQL = f"""
c1 AS (SELECT gen_id, generated_raw AS raw, regexp_replace(generated_raw, '(?is)<think>.*?</think>', '', 'g') AS closed FROM inference_records),
c2 AS (SELECT gen_id, raw, closed, CASE WHEN contains(lower(closed), '<think>') AND NOT contains(lower(closed), '</think>') THEN regexp_replace(closed, '(?is)<think>.*$', '', 'g') ELSE closed END AS opened FROM c1),
c3 AS (SELECT gen_id, raw, closed, {_STRIP(f"regexp_replace(opened, '{_ROLE_SQL}', '', 'g')")} AS cleaned FROM c2),
c4 AS (SELECT *, regexp_replace(cleaned, '{_SP}', '', 'g') AS solid, list_filter(regexp_split_to_array(cleaned, '{_SP}+'), lambda t: t <> '') AS toks FROM c3),
c5 AS (SELECT *, coalesce(length(regexp_replace(solid, '{_QUOTE(H.ALLOWED)}', '', 'g')) / nullif(length(solid), 0), 0.0) AS foreign_share,
  len(list_filter(range(1, length(cleaned) - 6), lambda i: NOT contains('-=#*_~. ' || chr(9) || chr(10) || '·', substr(cleaned, i, 1)) AND substr(cleaned, i, 8) = repeat(substr(cleaned, i, 1), 8))) > 0 AS wall,
  len(list_filter(range(1, len(toks) - 1), lambda i: toks[i] = toks[i + 1] AND toks[i + 1] = toks[i + 2])) > 0
    OR (len(toks) >= 12 AND len(list_distinct(list_transform(range(1, len(toks) - 2), lambda i: array_to_string(toks[i : i + 3], chr(1))))) < 0.5 * (len(toks) - 3)) AS rep FROM c4),
cleaned AS (SELECT *, CASE WHEN length(cleaned) < 3 THEN 'empty' WHEN wall THEN 'repetition' WHEN foreign_share > 0.15 THEN 'garbage'
  WHEN regexp_matches(cleaned, '(?i)(?://|_|\\|)\\s*thought\\b|<\\|?thought') THEN 'leak' WHEN rep THEN 'repetition' ELSE 'ok' END AS status FROM c5)"""
_ENDS = " OR ".join(f"ends_with(cleaned, '{e}')" for e in H.SOUND_ENDS)


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    x = spread(load(spark, d, "inference_records").select("gen_id", "sid", F.col("generated_raw").alias("raw")))
    x = once(x, "gen_id", "sid", "raw", cleaned=H.without_thinking(F.col("raw")))
    x = once(x, "gen_id", "sid", "raw", "cleaned", words=H.tokens(F.col("cleaned")))
    return once(x, "gen_id", "sid", "raw", "cleaned", status=F.when(F.col("raw").isNotNull(), H.status(F.col("cleaned"), F.col("words"))).otherwise("ok"))


def clean_status(spark, d):
    x = _cleaned(spark, d).where("raw is not null")
    return x.select("gen_id", "cleaned", "status", F.array_join(H.flags(F.col("raw"), F.col("cleaned"), F.col("status")), ",").alias("flags"))


def dedup_candidates(spark, d):
    x = _cleaned(spark, d).where("raw is not null and status = 'ok' and sid <> -1").withColumn("key", H.squeeze(F.col("cleaned")))
    first = F.row_number().over(W.partitionBy("sid", "key").orderBy("gen_id"))
    return x.withColumn("k", first).where("k = 1").select("gen_id", "sid", "key")


_RED_SQL = f"regexp_replace(regexp_replace(emr, '{H.LABELLED_NUMBER}', '[식별번호 제거]', 'g'), '{H.LABELLED_NAME}', '[이름 제거]', 'g')"


def length_percentiles(spark, d):
    x = load(spark, d, "documents").select("source", F.length("text").alias("n"))
    ps = [F.round(F.percentile("n", F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75, 0.9, 0.99)]
    return x.groupBy("source").agg(F.count("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"), *ps, F.count_if(F.col("n") > 2000).alias("over"))


QUERIES = {
    "clean_status": Query(
        clean_status,
        f"""WITH {CLEAN_SQL} SELECT gen_id, cleaned, status, array_to_string(list_filter([CASE WHEN contains(lower(raw), '<think>') THEN 'had_think_block' END, CASE WHEN regexp_matches(closed, '{_ROLE_SQL}') THEN 'had_role_lines' END,
CASE WHEN status = 'ok' AND regexp_matches(cleaned, '(?:을|를|이|가|에|의|로|와|과|은|는){_SP}*$') AND NOT ({_ENDS}) THEN 'maybe_truncated' END], lambda x: x IS NOT NULL), ',') AS flags FROM cleaned WHERE raw IS NOT NULL""",
    ),
    "foreign_share": Query(
        lambda s, d: _cleaned(s, d).where("raw is not null").select("gen_id", F.round(H.foreign_share(F.col("cleaned")), 6).alias("share")),
        f"WITH {CLEAN_SQL} SELECT gen_id, round(foreign_share, 6) AS share FROM cleaned WHERE raw IS NOT NULL",
    ),
    "no_issue_exact": Query(
        lambda s, d: load(s, d, "inference_records").select("gen_id", H.no_issue(F.col("generated")).alias("no_issue")),
        f"SELECT gen_id, {_NO_ISSUE_SQL('generated')} AS no_issue FROM inference_records",
    ),
    "normalize_dedup": Query(
        dedup_candidates,
        f"WITH {CLEAN_SQL}, k AS (SELECT gen_id, sid, {_SQUEEZE('cleaned')} AS key FROM cleaned JOIN inference_records USING (gen_id) "
        "WHERE raw IS NOT NULL AND status = 'ok' AND sid <> -1) SELECT gen_id, sid, key FROM k QUALIFY row_number() OVER (PARTITION BY sid, key "
        "ORDER BY gen_id) = 1",
    ),
    "status_disagreement": Query(
        lambda s, d: _cleaned(s, d).where("raw is not null").join(load(s, d, "inference_records").select("gen_id", F.lower("gen_status").alias("stored")), "gen_id").groupBy("stored", "status").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {CLEAN_SQL} SELECT lower(gen_status) AS stored, status, count(*) AS n FROM cleaned JOIN inference_records USING (gen_id) WHERE raw IS NOT NULL "
        "GROUP BY ALL",
    ),
    "label_scrub": Query(
        lambda s, d: load(s, d, "fewshot_bank").where("emr is not null").select("rec_id", H.scrub_labels(F.col("emr")).alias("emr")),
        f"SELECT rec_id, {_RED_SQL} AS emr FROM fewshot_bank WHERE emr IS NOT NULL",
    ),
    "display_cap": Query(
        lambda s, d: load(s, d, "documents").select("doc_id", F.when(F.length("text") > 2600, F.concat(F.substring("text", 1, 2600), F.lit(" …"))).otherwise(F.col("text")).alias("text")),
        "SELECT doc_id, CASE WHEN length(text) > 2600 THEN substr(text, 1, 2600) || ' …' ELSE text END AS text FROM documents",
    ),
    "length_percentiles": Query(
        length_percentiles,
        "SELECT source, count(length(text)) AS n, min(length(text)) AS lo, max(length(text)) AS hi, " + ", ".join(f"round(quantile_cont(length(text), {p}), 6) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.99)) + ", count(*) FILTER (WHERE length(text) > 2000) AS over FROM documents GROUP BY source",
    ),
}
