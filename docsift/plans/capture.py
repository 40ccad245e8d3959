"""E2 ``extract``: captured tabs → merged tab lists → manifests and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.capture import (FLAT_COLUMNS, build_manifests, capture, manifest_rollup,
                                 read_manifests, tab_files)
from ..sources.tables import CAPTURE_TABS_SQL, capture_tabs, table
from . import sqlfrag as S


def q_capture_manifest(spark, sf_dir):
    """Flat manifest rows."""
    return capture(capture_tabs(spark, sf_dir)).select(*FLAT_COLUMNS)


def q_manifest_roundtrip(spark, sf_dir):
    """S6 then S5: manifests written as JSON and parsed back."""
    return read_manifests(build_manifests(capture(capture_tabs(spark, sf_dir)))).select(*FLAT_COLUMNS)


def q_capture_rollup(spark, sf_dir):
    """A4: tabs / chars / windows per window and per session."""
    return manifest_rollup(capture(capture_tabs(spark, sf_dir)))


def q_tab_files(spark, sf_dir):
    """Written files (empty tabs excluded)."""
    return tab_files(capture(capture_tabs(spark, sf_dir)))


def q_capture_keys(spark, sf_dir):
    """P3 on raw tabs: capture key text length and hash."""
    t = capture_tabs(spark, sf_dir)
    return t.select("window_id", "turn", F.length(X.capture_key("text")).alias("key_len"),
                    X.capture_hash("text").alias("key"))


def _doc_variants(df):
    """Headers that exercise the classifier (none occur in the table)."""
    lf = F.lit("\n")
    d, t = F.col("doc_id"), F.col("text")
    return df.withColumn("text", F.when(d % 6 == 1, F.concat(F.lit("# Title"), lf, t))
                         .when(d % 6 == 2, F.concat(F.lit("[core]"), lf, t))
                         .when(d % 6 == 3, F.concat(F.lit("["), t, F.lit("]")))
                         .when(d % 6 == 4, F.concat(F.lit("Intro"), lf, F.lit("## Part"), lf, t))
                         .otherwise(t))


def q_text_functions(spark, sf_dir):
    """P4, P5, P6, P18 over every document (with injected headers)."""
    docs = _doc_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.concat(F.lit(" .x<"), F.substring("text", 1, 70), F.lit(":?* . "))
    return docs.select(
        "doc_id",
        X.tab_label("text").alias("label"),
        X.detect_file_type("text").alias("file_type"),
        X.sanitize_filename(name).alias("safe_name"),
        X.clean_tab_name(F.concat(F.substring("text", 1, 30),
                                  F.when(F.col("doc_id") % 2 == 0, F.lit(". Modified. "))
                                  .otherwise(F.lit(". Unmodified.")))).alias("tab_name"),
    )


# ---------------------------------------------------------------------------
# Oracle SQL
# ---------------------------------------------------------------------------

_TABS = CAPTURE_TABS_SQL.replace("@@STRIP_FIRST@@", S.strip(S.first_line("first_text")))

NUMBERED_SQL = f"""
tabs AS ({_TABS}),
t AS (SELECT *, sha256({S.capture_key('text')}) AS key, {S.tab_label('text')} AS label FROM tabs),
p1 AS (SELECT *, row_number() OVER (PARTITION BY session_id, window_id ORDER BY turn) - 1 AS tab_index
       FROM t WHERE phase = 1),
p1c AS (SELECT session_id, window_id, count(*) AS p1_count FROM p1 GROUP BY session_id, window_id),
seen AS (SELECT DISTINCT session_id, key FROM p1 WHERE text <> ''),
p2 AS (SELECT t.* FROM t WHERE phase = 2 AND text <> ''
       AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.session_id = t.session_id AND s.key = t.key)),
p2f AS (SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (PARTITION BY session_id, key ORDER BY window_id, turn) AS rn FROM p2)
        WHERE rn = 1),
kept AS (SELECT p2f.*, coalesce(p1c.p1_count, 0)
                + row_number() OVER (PARTITION BY p2f.session_id, p2f.window_id ORDER BY p2f.turn) - 1 AS tab_index
         FROM p2f LEFT JOIN p1c USING (session_id, window_id)),
merged AS (
  SELECT session_id, window_id, title, turn, phase, child_handle, text, key, label, tab_index FROM p1
  UNION ALL
  SELECT session_id, window_id, title, turn, phase, child_handle, text, key, label, tab_index FROM kept),
numbered AS (
  SELECT session_id, window_id, text,
         CAST(dense_rank() OVER (PARTITION BY session_id ORDER BY window_id) AS INTEGER) AS window_index,
         printf('window%02d', dense_rank() OVER (PARTITION BY session_id ORDER BY window_id)) AS folder,
         title, starts_with(title, '*') AS has_unsaved,
         CAST(count(*) OVER (PARTITION BY session_id, window_id) AS INTEGER) AS tab_count,
         CAST(tab_index + 1 AS INTEGER) AS "index",
         CASE WHEN text IS NOT NULL AND text <> '' THEN printf('tab%02d.txt', tab_index + 1) END AS filename,
         label,
         CAST(CASE WHEN text IS NOT NULL AND text <> '' THEN length(text) ELSE 0 END AS INTEGER) AS chars,
         CASE WHEN text IS NOT NULL AND text <> '' THEN {S.file_type('text')} ELSE 'empty' END AS content_type,
         CASE WHEN child_handle IS NOT NULL THEN 'silent' ELSE 'select' END AS method
  FROM merged)
"""

_FLAT = ", ".join(f'"{c}"' for c in FLAT_COLUMNS)
SQL_CAPTURE_MANIFEST = f"WITH {NUMBERED_SQL} SELECT {_FLAT} FROM numbered"

SQL_CAPTURE_ROLLUP = f"""WITH {NUMBERED_SQL}
SELECT session_id, window_index, count(*) AS tabs, CAST(sum(chars) AS BIGINT) AS chars,
       count(DISTINCT window_index) AS windows
FROM numbered GROUP BY ROLLUP (session_id, window_index) HAVING session_id IS NOT NULL"""

SQL_TAB_FILES = f"WITH {NUMBERED_SQL} SELECT session_id, folder, filename, text FROM numbered WHERE filename IS NOT NULL"

SQL_CAPTURE_KEYS = f"""WITH tabs AS ({_TABS})
SELECT window_id, turn, CAST(length({S.capture_key('text')}) AS INTEGER) AS key_len, sha256({S.capture_key('text')}) AS key FROM tabs"""

SQL_TEXT_FUNCTIONS = f"""WITH d0 AS (SELECT doc_id, text AS raw FROM documents),
docs AS (SELECT doc_id, CASE
    WHEN doc_id % 6 = 1 THEN '# Title' || chr(10) || raw
    WHEN doc_id % 6 = 2 THEN '[core]' || chr(10) || raw
    WHEN doc_id % 6 = 3 THEN '[' || raw || ']'
    WHEN doc_id % 6 = 4 THEN 'Intro' || chr(10) || '## Part' || chr(10) || raw
    ELSE raw END AS text FROM d0)
SELECT doc_id, {S.tab_label('text')} AS label, {S.file_type('text')} AS file_type,
       {S.sanitize("(' .x<' || substr(text, 1, 70) || ':?* . ')")} AS safe_name,
       {S.strip("replace(replace(substr(text, 1, 30) || CASE WHEN doc_id % 2 = 0 THEN '. Modified. ' ELSE '. Unmodified.' END, '. Modified.', ''), '. Unmodified.', '')")} AS tab_name
FROM docs"""


def register_queries(register):
    register("capture_manifest", q_capture_manifest, SQL_CAPTURE_MANIFEST)
    register("manifest_roundtrip", q_manifest_roundtrip, SQL_CAPTURE_MANIFEST)
    register("capture_rollup", q_capture_rollup, SQL_CAPTURE_ROLLUP)
    register("tab_files", q_tab_files, SQL_TAB_FILES)
    register("capture_keys", q_capture_keys, SQL_CAPTURE_KEYS)
    register("text_functions", q_text_functions, SQL_TEXT_FUNCTIONS)
