"""Side jobs on the driver tables: curve scoring and fit (A10, A11), traffic
history (J13, J14, U3, A12), recently-used lists (W6), tab correlation and
coverage (J12, A9), unified diffs of near matches (P20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.threshold import DEFAULT_CURVE
from ..operators import coverage as V
from ..operators import curves as C
from ..operators import history as H
from ..operators.linediff import unified_diffs
from ..session import broadcast_if_small, scratch_path, write_scratch
from ..sources.tables import CAPTURE_TABS_SQL, capture_tabs, inventory, table
from . import sqlfrag as S
from .compare import compare
from .nearsql import SQL_UNIFIED_DIFF

T = DEFAULT_CURVE
RECENT_DEPTH = 10


# -- curves ---------------------------------------------------------------------

def _anchors(spark, sf_dir):
    """(lang, size, expected): the threshold applied at every text length."""
    d = table(spark, sf_dir, "documents").select("lang", F.length("text").alias("size"))
    return d.filter(F.col("size") > 1).select("lang", "size", T.column("size").alias("expected"))


def q_score_curves(spark, sf_dir):
    return C.score_curves(_anchors(spark, sf_dir).select("size", "expected").distinct())


def q_fit_curve(spark, sf_dir):
    return C.fit_log_quadratic(_anchors(spark, sf_dir), ["lang"])


# -- traffic history -------------------------------------------------------------

def _day(ts):
    return F.date_format(ts, "yyyy-MM-dd'T'00:00:00'Z'")


def _is_stored(ts):
    """Even days are in the stored history already; purchases of odd days are
    traffic still to be merged, so every event counts on one side."""
    return F.dayofmonth(ts) % 2 == 0


def _series(spark, sf_dir, kind, open_purchases=False):
    wanted = F.col("event_type") == kind
    if open_purchases:
        wanted |= (F.col("event_type") == "purchase") & ~_is_stored(F.col("ts"))
    ev = table(spark, sf_dir, "events").filter(wanted)
    return ev.groupBy(_day(F.col("ts")).alias("timestamp")).agg(
        F.count(F.lit(1)).cast("int").alias("count"), F.countDistinct("user_id").cast("int").alias("uniques"))


def _stored_history(spark, sf_dir):
    p = _series(spark, sf_dir, "purchase").filter(F.substring("timestamp", 9, 2).cast("int") % 2 == 0)
    z = F.lit(0).cast("int")
    return p.select(
        F.col("timestamp").alias("date"), F.replace(F.col("timestamp"), F.lit("T00:00:00Z"), F.lit("T12:00:00.000Z"))
        .alias("capturedAt"), F.col("count").alias("clones"), z.alias("downloads"), z.alias("views"),
        F.col("count").alias("total"), z.alias("ciCheckouts"), F.col("count").alias("organicClones"),
        z.alias("stars"), z.alias("forks"), z.alias("openIssues"), F.col("uniques").alias("uniqueClones"),
        z.alias("uniqueViews"), z.alias("ciRuns"), F.col("uniques").alias("organicUniqueClones"))


def q_traffic_merge(spark, sf_dir):
    return H.merge_traffic(_series(spark, sf_dir, "click"), _series(spark, sf_dir, "view"))


def q_date_union(spark, sf_dir):
    return H.date_union(_series(spark, sf_dir, "click"), _series(spark, sf_dir, "view"))


def _backfilled(spark, sf_dir):
    merged = H.merge_traffic(_series(spark, sf_dir, "click", open_purchases=True), _series(spark, sf_dir, "view"))
    return H.backfill(_stored_history(spark, sf_dir), merged)


def q_history_backfill(spark, sf_dir):
    return _backfilled(spark, sf_dir)


def q_tracking_since(spark, sf_dir):
    return H.tracking_summary(_backfilled(spark, sf_dir))


# -- recently used -----------------------------------------------------------------

def _pushes(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("owner"), F.get_json_object("props", "$.k").alias("item"),
                     "ts", F.col("event_id").alias("seq"))


def q_recent_items(spark, sf_dir):
    return H.recent_items(_pushes(spark, sf_dir), RECENT_DEPTH)


def q_nth_recent(spark, sf_dir):
    return H.nth_recent(H.recent_items(_pushes(spark, sf_dir), RECENT_DEPTH), 2)


# -- tab correlation and coverage ----------------------------------------------------

def _names_texts(spark, sf_dir):
    tabs = capture_tabs(spark, sf_dir)
    suffix = F.when(F.col("turn") % 2 == 0, F.lit(". Modified.")).otherwise(F.lit(". Unmodified."))
    names = tabs.select("window_id", F.col("turn").alias("name_idx"),
                        F.concat(F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, 35), suffix)
                        .alias("name"))
    texts = tabs.filter(F.col("phase") == 1).select("window_id", F.col("turn").alias("text_idx"), "text")
    return names, texts


def q_prefix_pairs(spark, sf_dir):
    names, texts = _names_texts(spark, sf_dir)
    return V.prefix_pairs(names, texts)


def q_prefix_pairs_30(spark, sf_dir):
    """J12 by the first 30 characters of a text."""
    names, texts = _names_texts(spark, sf_dir)
    return V.prefix_pairs(names, texts, text_prefix=30)


def q_tab_assignment(spark, sf_dir):
    names, texts = _names_texts(spark, sf_dir)
    return V.assign(V.prefix_pairs(names, texts))


def q_coverage(spark, sf_dir):
    names, texts = _names_texts(spark, sf_dir)
    return V.coverage(names, texts, V.assign(V.prefix_pairs(names, texts)))


# -- unified diffs ---------------------------------------------------------------------

def q_unified_diff(spark, sf_dir):
    """P20 for every near match: only the documents of near pairs are read
    back and normalised, once (their paths are broadcast behind a check of their
    bytes). The near matches are written first: both sides' paths are theirs."""
    from ..functions.text import normalize_text

    def written(df, name):
        return write_scratch(df, scratch_path(spark, f"linediff/{name}-{uuid.uuid4().hex[:12]}"))

    res = compare(spark, sf_dir, fuzzy="small", scope="all").filter(F.col("status") == "near")
    res = written(res.select("new_path", "canonical_path"), "near")
    needed = res.select(F.col("new_path").alias("path")).union(
        res.select(F.col("canonical_path").alias("path"))).distinct()
    texts = (inventory(spark, sf_dir).select("path", "text").join(broadcast_if_small(needed), "path", "left_semi")
             .select("path", normalize_text("text").alias("norm")))
    texts = written(texts, "texts")
    pairs = (res.join(texts.withColumnRenamed("path", "new_path").withColumnRenamed("norm", "new_text"), "new_path")
             .join(texts.withColumnRenamed("path", "canonical_path").withColumnRenamed("norm", "canonical_text"),
                   "canonical_path"))
    return unified_diffs(pairs)


# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------

ANCHORS_SQL = f"""anchors AS (
  SELECT lang, length(text) AS size, {T.sql('length(text)')} AS expected FROM documents WHERE length(text) > 1)"""

SQL_SCORE_CURVES = f"""WITH {ANCHORS_SQL},
a AS (SELECT DISTINCT size, expected FROM anchors),
v AS (
  SELECT expected, 'sqrt' AS curve, {C.SQRT_K} * sqrt(size) AS actual FROM a
  UNION ALL SELECT expected, 'log', CASE WHEN size <= 1 THEN 0.0 ELSE greatest(0.0, {C.LOG_A} * ln(size) + ({C.LOG_B})) END FROM a
  UNION ALL SELECT expected, 'power', {C.POWER_A} * pow(size, {C.POWER_P}) FROM a
  UNION ALL SELECT expected, 'sqrt_capped', greatest({C.CAP_MIN}, least({C.SQRT_K} * sqrt(size), size * {C.CAP_PCT})) FROM a
  UNION ALL SELECT expected, 'power_capped', greatest({C.CAP_MIN}, least({C.POWER_A} * pow(size, {C.POWER_P}), size * {C.CAP_PCT})) FROM a
  UNION ALL SELECT expected, 'log_quadratic', {T.a} * ln(size) * ln(size) + ({T.b}) * ln(size) + {T.c} FROM a),
s AS (SELECT curve, round(avg(abs(actual - expected) / expected * 100), 4) AS avg_error_pct,
             round(max(abs(actual - expected) / expected * 100), 4) AS max_error_pct, count(*) AS anchors
      FROM v GROUP BY curve)
SELECT *, CAST(rank() OVER (ORDER BY avg_error_pct) AS INTEGER) AS rank FROM s"""

SQL_FIT_CURVE = f"""WITH {ANCHORS_SQL},
g AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, sum(ln(size)) AS s1, sum(ln(size)^2) AS s2, sum(ln(size)^3) AS s3,
             sum(ln(size)^4) AS s4, sum(CAST(expected AS DOUBLE)) AS t0, sum(ln(size) * expected) AS t1,
             sum(ln(size)^2 * expected) AS t2
      FROM anchors GROUP BY lang),
d AS (SELECT *,
  s4 * (s2 * n - s1 * s1) - s3 * (s3 * n - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS det,
  t2 * (s2 * n - s1 * s1) - s3 * (t1 * n - s1 * t0) + s2 * (t1 * s1 - s2 * t0) AS da,
  s4 * (t1 * n - s1 * t0) - t2 * (s3 * n - s1 * s2) + s2 * (s3 * t0 - t1 * s2) AS db,
  s4 * (s2 * t0 - t1 * s1) - s3 * (s3 * t0 - t1 * s2) + t2 * (s3 * s1 - s2 * s2) AS dc
  FROM g)
SELECT lang, CAST(n AS BIGINT) AS points, round(da / det, 3) AS a, round(db / det, 3) AS b, round(dc / det, 3) AS c FROM d"""

SERIES_SQL = """
click AS (SELECT strftime(ts, '%Y-%m-%dT00:00:00Z') AS timestamp, CAST(count(*) AS INTEGER) AS count,
                 CAST(count(DISTINCT user_id) AS INTEGER) AS uniques FROM events WHERE event_type = 'click' GROUP BY 1),
view AS (SELECT strftime(ts, '%Y-%m-%dT00:00:00Z') AS timestamp, CAST(count(*) AS INTEGER) AS count,
                CAST(count(DISTINCT user_id) AS INTEGER) AS uniques FROM events WHERE event_type = 'view' GROUP BY 1),
merged AS (SELECT coalesce(c.timestamp, v.timestamp) AS date,
                  CAST(coalesce(c.count, 0) AS INTEGER) AS clones, CAST(coalesce(c.uniques, 0) AS INTEGER) AS clone_uniques,
                  CAST(coalesce(v.count, 0) AS INTEGER) AS views, CAST(coalesce(v.uniques, 0) AS INTEGER) AS view_uniques
           FROM click c FULL OUTER JOIN view v ON c.timestamp = v.timestamp)"""

HISTORY_SQL = SERIES_SQL.replace("event_type = 'click'", "(event_type = 'click' OR (event_type = 'purchase' AND day(ts) % 2 = 1))") + """,
purchase AS (SELECT strftime(ts, '%Y-%m-%dT00:00:00Z') AS timestamp, CAST(count(*) AS INTEGER) AS count,
                    CAST(count(DISTINCT user_id) AS INTEGER) AS uniques FROM events WHERE event_type = 'purchase' GROUP BY 1),
stored AS (SELECT timestamp AS date, replace(timestamp, 'T00:00:00Z', 'T12:00:00.000Z') AS capturedAt,
                  count AS clones, 0 AS downloads, 0 AS views, count AS total, 0 AS ciCheckouts, count AS organicClones,
                  0 AS stars, 0 AS forks, 0 AS openIssues, uniques AS uniqueClones, 0 AS uniqueViews, 0 AS ciRuns,
                  uniques AS organicUniqueClones, FALSE AS added
           FROM purchase WHERE CAST(substr(timestamp, 9, 2) AS INTEGER) % 2 = 0),
added AS (SELECT date, date AS capturedAt, clones, 0 AS downloads, views, clones + views AS total, 0 AS ciCheckouts,
                 clones AS organicClones, 0 AS stars, 0 AS forks, 0 AS openIssues, clone_uniques AS uniqueClones,
                 view_uniques AS uniqueViews, 0 AS ciRuns, clone_uniques AS organicUniqueClones, TRUE AS added
          FROM merged m WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.date = m.date)),
hist AS (SELECT * FROM stored UNION ALL SELECT * FROM added)"""

SQL_TRAFFIC_MERGE = f"WITH {SERIES_SQL} SELECT * FROM merged"
SQL_DATE_UNION = f"WITH {SERIES_SQL} SELECT DISTINCT date FROM (SELECT timestamp AS date FROM click UNION ALL SELECT timestamp FROM view)"
SQL_HISTORY_BACKFILL = f"WITH {HISTORY_SQL} SELECT * FROM hist"
SQL_TRACKING_SINCE = f"""WITH {HISTORY_SQL}
SELECT min(date) AS tracking_since, count(*) AS days, count(*) FILTER (WHERE added) AS added_days FROM hist"""

RECENT_SQL = f"""last AS (SELECT * FROM (
    SELECT user_id AS owner, json_extract_string(props, '$.k') AS item, ts, event_id,
           row_number() OVER (PARTITION BY user_id, json_extract_string(props, '$.k') ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1),
ranked AS (SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank,
                  item, ts AS last_ts FROM last)"""
SQL_RECENT_ITEMS = f"WITH {RECENT_SQL} SELECT * FROM ranked WHERE rank <= {RECENT_DEPTH}"
SQL_NTH_RECENT = f"WITH {RECENT_SQL} SELECT owner, item FROM ranked WHERE rank = 2"

_TABS = CAPTURE_TABS_SQL.replace("@@STRIP_FIRST@@", S.strip(S.first_line("first_text")))
_clean_name = S.strip("replace(replace(name, '. Modified.', ''), '. Unmodified.', '')")
_text_start = S.strip("replace(replace(replace(replace(substr(text, 1, 50), chr(13) || chr(10), ''), chr(13), ''), "
                      "chr(10), ''), chr(160), ' ')")
SQL_PREFIX_PAIRS = f"""WITH tabs AS ({_TABS}),
names AS (SELECT window_id, turn AS name_idx,
                 substr(replace(text, chr(10), ' '), 1, 35) || CASE WHEN turn % 2 = 0 THEN '. Modified.' ELSE '. Unmodified.' END AS name
          FROM tabs),
n AS (SELECT *, {_clean_name} AS clean FROM names),
t AS (SELECT window_id, turn AS text_idx, text, {_text_start} AS start FROM tabs WHERE phase = 1 AND text IS NOT NULL AND text <> '')
SELECT n.window_id, n.name_idx, t.text_idx FROM n JOIN t USING (window_id)
WHERE n.clean <> '' AND starts_with(t.start, substr(n.clean, 1, 25))"""

SQL_PREFIX_PAIRS_30 = SQL_PREFIX_PAIRS.replace("substr(text, 1, 50)", "substr(text, 1, 30)")


def _assignment_ctes() -> str:
    """CTE chain ending in ``assigned``: the greedy one-to-one assignment as
    a recursion over each window's names, carrying the texts already used."""
    body = SQL_PREFIX_PAIRS[len("WITH "):]
    i = body.rindex("SELECT n.window_id")
    ctes, final = body[:i].rstrip().rstrip(","), body[i:]
    return f"""{ctes},
pairs AS ({final}),
pnames AS (SELECT window_id, name_idx, row_number() OVER (PARTITION BY window_id ORDER BY name_idx) AS r
           FROM (SELECT DISTINCT window_id, name_idx FROM pairs)),
rec(window_id, r, used, name_idx, text_idx) AS (
  SELECT DISTINCT window_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  FROM pnames
  UNION ALL
  SELECT window_id, r, CASE WHEN text_idx IS NULL THEN used ELSE list_append(used, text_idx) END, name_idx, text_idx
  FROM (
    SELECT rec.window_id, rec.r + 1 AS r, rec.used, n.name_idx,
           (SELECT min(p.text_idx) FROM pairs p WHERE p.window_id = rec.window_id AND p.name_idx = n.name_idx
              AND NOT list_contains(rec.used, p.text_idx)) AS text_idx
    FROM rec JOIN pnames n ON n.window_id = rec.window_id AND n.r = rec.r + 1)),
assigned AS (SELECT window_id, name_idx, text_idx FROM rec WHERE text_idx IS NOT NULL)"""


SQL_TAB_ASSIGNMENT = f"WITH RECURSIVE {_assignment_ctes()} SELECT * FROM assigned"
SQL_COVERAGE = f"""WITH RECURSIVE {_assignment_ctes()},
per_win AS (SELECT window_id, count(*) AS tabs FROM names GROUP BY window_id),
lw AS (SELECT window_id, count(*) AS loaded FROM tabs WHERE phase = 1 GROUP BY window_id),
tw AS (SELECT window_id, count(*) AS with_text, sum(length(text)) AS chars FROM tabs
       WHERE phase = 1 AND text IS NOT NULL AND text <> '' GROUP BY window_id),
mw AS (SELECT window_id, count(*) AS matched FROM assigned GROUP BY window_id),
w AS (SELECT p.window_id, p.tabs, coalesce(lw.loaded, 0) AS loaded, coalesce(tw.with_text, 0) AS with_text,
             coalesce(tw.chars, 0) AS chars, coalesce(mw.matched, 0) AS matched
      FROM per_win p LEFT JOIN lw USING (window_id) LEFT JOIN tw USING (window_id) LEFT JOIN mw USING (window_id))
SELECT count(*) AS windows, CAST(sum(tabs) AS BIGINT) AS total_tabs, CAST(sum(loaded) AS BIGINT) AS loaded_tabs,
       CAST(sum(with_text) AS BIGINT) AS tabs_with_text, CAST(sum(tabs - matched) AS BIGINT) AS tabs_unloaded,
       CAST(sum(chars) AS BIGINT) AS total_chars,
       round(CAST(sum(with_text) AS DOUBLE) / greatest(sum(tabs), 1) * 100, 1) AS coverage_pct
FROM w"""


def register_queries(register):
    register("score_curves", q_score_curves, SQL_SCORE_CURVES)
    register("fit_curve", q_fit_curve, SQL_FIT_CURVE)
    register("traffic_merge", q_traffic_merge, SQL_TRAFFIC_MERGE)
    register("date_union", q_date_union, SQL_DATE_UNION)
    register("history_backfill", q_history_backfill, SQL_HISTORY_BACKFILL)
    register("tracking_since", q_tracking_since, SQL_TRACKING_SINCE)
    register("recent_items", q_recent_items, SQL_RECENT_ITEMS)
    register("nth_recent", q_nth_recent, SQL_NTH_RECENT)
    register("prefix_pairs", q_prefix_pairs, SQL_PREFIX_PAIRS)
    register("prefix_pairs_30", q_prefix_pairs_30, SQL_PREFIX_PAIRS_30)
    register("tab_assignment", q_tab_assignment, SQL_TAB_ASSIGNMENT)
    register("coverage", q_coverage, SQL_COVERAGE)
    register("unified_diff", q_unified_diff, SQL_UNIFIED_DIFF)
