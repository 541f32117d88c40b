"""Problems 4 and 5: readings on a regular grid, and implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.normalize import epoch_us
from ..operators import gridfill, spikes
from ..operators.readings import readings, timed
from ..session import load, spread
from .query import Query

_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_BLANK = r"[\s\x{a0}\x{2000}-\x{200d}\x{3000}\x{feff}]+"

READINGS_SQL = f"""
raw_rows AS (
  SELECT row_id, sid, epoch_us(ts) AS us, value_raw,
    upper(regexp_replace(regexp_split_to_array(translate(item_raw, '{_WIDE}', '{_ASCII}'), '<|←|⇐|⟵|↤|⬅|◀|◄')[1], '{_BLANK}', '', 'g')) AS k,
    translate(translate(value_raw, '{_WIDE}', '{_ASCII}'), '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹,−', '01234567890123456789.-') AS t
  FROM vital_df WHERE sid IS NOT NULL AND sid <> -1),
numbers AS (
  SELECT row_id, sid, us, k, value_raw, try_cast(nullif(regexp_extract(t, '(^|[^A-Za-z0-9.-]|[^A-Za-z0-9.])(-?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?)', 2), '') AS DOUBLE) AS v FROM raw_rows),
readings AS (
  SELECT n.row_id, n.sid, r.item, n.us, n.v, r.plausible_lo AS lo, r.plausible_hi AS hi, r.min_jump, r.grid_min
  FROM numbers n JOIN item_ref r ON n.k = upper(r.item)
  WHERE n.us IS NOT NULL AND n.v IS NOT NULL AND (n.v <> 0 OR r.item IN ('EBL', 'UO')))"""

P4_FOUND_SQL = f"""
WITH {READINGS_SQL},
p AS (SELECT sid, item, grid_min, us, lead(us) OVER (PARTITION BY sid, item ORDER BY us) AS nx FROM readings),
g AS (SELECT sid, item, grid_min, (us // (grid_min * 60000000::BIGINT)) * grid_min AS a, (nx // (grid_min * 60000000::BIGINT)) * grid_min AS b
      FROM p WHERE nx - us <= 21600000000)
SELECT sid, item, unnest(range(a + grid_min, b, grid_min::BIGINT)) AS slot_min FROM g WHERE b - a > grid_min"""

P5_FOUND_SQL = f"""
WITH {READINGS_SQL},
bad AS (SELECT row_id FROM readings WHERE coalesce(v < lo, false) OR coalesce(v > hi, false)),
sound AS (SELECT sid, item, us, v, min_jump, min(row_id) AS row_id FROM readings WHERE row_id NOT IN (SELECT row_id FROM bad) GROUP BY ALL),
s1 AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sid, item) AS n, lag(v) OVER w AS was FROM sound
       WINDOW w AS (PARTITION BY sid, item ORDER BY us, v)),
chg AS (SELECT sid, item, median(round(abs(v - was), 6)) AS med, count(was) AS changes, count(*) FILTER (WHERE v <> was) AS changed FROM s1 GROUP BY sid, item),
s2 AS (SELECT s1.*, med, changes, changed, sum(CASE WHEN was IS NULL OR was <> v THEN 1 ELSE 0 END) OVER (PARTITION BY sid, item ORDER BY rn) AS run_id
       FROM s1 JOIN chg USING (sid, item)),
s3 AS (SELECT *, count(*) OVER (PARTITION BY sid, item, run_id) AS run, greatest(min_jump, 8 * med) - 1e-9 AS lim FROM s2),
-- each run of one to three readings with the readings around it
runs AS (SELECT s3.*, l, list(v) OVER (PARTITION BY sid, item, l ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
           list(v) OVER (PARTITION BY sid, item, l ORDER BY rn ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS f
         FROM s3, (VALUES (1), (2), (3)) AS r(l) WHERE min_jump IS NOT NULL),
levels AS (SELECT *, f[1 : l] AS r, f[l + 1 : l + 5] AS x, list_median(b) AS lb, list_median(f[l + 1 : l + 5]) AS la FROM runs WHERE rn > 1 AND rn + l <= n),
spikes AS (SELECT DISTINCT sid, item, unnest(range(rn, rn + l)) AS rn FROM levels
           WHERE len(list_filter(r, lambda y: y - greatest(la, lb) >= lim OR least(la, lb) - y >= lim)) = l AND abs(b[-1] - lb) < lim AND abs(x[1] - la) < lim),
hits AS (
  SELECT sid, item, us, v, CASE WHEN run >= 10 AND 2 * changed > changes THEN 'stuck' ELSE 'spike' END AS kind
  FROM s3 LEFT JOIN spikes p USING (sid, item, rn) WHERE run >= 10 AND 2 * changed > changes OR p.sid IS NOT NULL)
SELECT row_id, 'impossible' AS kind FROM bad
UNION ALL
SELECT q.row_id, h.kind FROM readings q JOIN hits h USING (sid, item, us, v)"""


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return readings(spread(load(spark, d, "vital_df").select("row_id", "sid", "ts", "item_raw", "value_raw")), load(spark, d, "item_ref"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return timed(spread(load(spark, d, "vital_df").select("row_id", "sid", "ts", "item_raw", "value_raw")), load(spark, d, "item_ref"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots without a reading between successive readings of a session."""
    return gridfill.gaps(_readings(spark, d))


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid of each source, filled or marked, and extended to its case's start and end of anaesthesia."""
    bounds = load(spark, d, "emr_case").select("sid", epoch_us(F.col("anes_start")).alias("lo_us"), epoch_us(F.col("anes_end")).alias("hi_us"))
    return gridfill.regular_grid(_readings(spark, d), bounds=bounds).withColumn("value", F.round("value", 6))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Impossible, stuck and spiking readings."""
    return spikes.implausible(_readings(spark, d))


P4_GRID_SQL = f"""SELECT sid, item, slot_min, round(value, 6) AS value, state FROM (
WITH {READINGS_SQL},
slots AS (SELECT sid, item, grid_min, (us // (grid_min * 60000000::BIGINT)) * grid_min AS slot_min, avg(v) AS value, min(us) AS f, max(us) AS us FROM readings GROUP BY ALL),
p AS (SELECT *, lead(slot_min) OVER w AS ns, lead(value) OVER w AS nv, lead(f) OVER w AS nf FROM slots WINDOW w AS (PARTITION BY sid, item ORDER BY slot_min)),
fill AS (SELECT *, unnest(range(slot_min + grid_min, ns, grid_min::BIGINT)) AS s FROM p WHERE nf - us <= 21600000000 AND ns - slot_min > grid_min),
ends AS (SELECT sid, item, grid_min, min(slot_min) AS a, max(slot_min) AS b, (epoch_us(anes_start) // (grid_min * 60000000::BIGINT)) * grid_min AS lo, (epoch_us(anes_end) // (grid_min * 60000000::BIGINT)) * grid_min AS hi
         FROM slots JOIN emr_case USING (sid) WHERE anes_start <= anes_end GROUP BY ALL)
SELECT sid, item, slot_min, value, 'observed' AS state FROM slots
UNION ALL SELECT sid, item, s, CASE WHEN ns - slot_min - grid_min <= 30 THEN value + (s - slot_min) / (ns - slot_min) * (nv - value) END, CASE WHEN ns - slot_min - grid_min <= 30 THEN 'interpolated' ELSE 'missing' END FROM fill
UNION ALL SELECT sid, item, unnest(range(lo, a, grid_min::BIGINT)), NULL, 'before' FROM ends WHERE lo < a
UNION ALL SELECT sid, item, unnest(range(b + grid_min, hi + 1, grid_min::BIGINT)), NULL, 'after' FROM ends WHERE hi > b)"""

QUERIES = {
    "p4_found": Query(p4_found, P4_FOUND_SQL),
    "p4_grid": Query(p4_grid, P4_GRID_SQL),
    "p5_found": Query(p5_found, P5_FOUND_SQL),
}
