"""Readers for the parquet tables and the document inventory built on them.

The inventory maps the ``documents`` table onto captured sessions:

* session    = ``source`` (``srcN``), named ``nc-2024-01-DD__09-00-00`` with
               DD = N + 1, so name order is time order; newest first.
* current    = the newest sessions (``srcN`` with N >= 16); history = the rest.
* organised  = the document has a row in ``labels``; its category is ``lang``.
* path       = ``<session>/organized/<lang>/doc<id>.txt`` for organised copies,
               ``<session>/windowWW/tab<id>.txt`` otherwise (WW = id % 4 + 1).
* ctime      = ``doc_id`` (monotone surrogate for creation time).

Texts are varied deterministically so the normaliser has something to undo
(the table has no CR, trailing blanks or blank texts): see ``captured_text``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import LEGACY_SESSION_PREFIX

CURRENT_FROM = 16  # srcN with N >= 16 is the session being compared


# Tables whose rows carry text that the queries process row by row.
TEXT_TABLES = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Give a scan at least twice ``defaultParallelism`` partitions.

    A file with few row groups is read by few tasks, and the per-row text
    work after the scan (regexes, hashing, UDFs) would run on just those
    tasks. Large inputs already have many more splits than cores and are
    left untouched, so no corpus-sized shuffle is added at scale."""
    # Byte-based splits can outnumber the row groups that actually hold
    # data, hence the factor two.
    try:
        target = 2 * df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no SparkContext (Spark Connect): leave as is
        return df
    if parts < target:
        # hash on the leading id column: deterministic, no pre-sort of rows
        return df.repartition(target, df.columns[0])
    return df


def captured_text(doc_id: Column, text: Column) -> Column:
    """Deterministic capture noise, one kind per document.

    id % 7 = 1   : CRLF line ends
    id % 11 = 2  : two trailing spaces and two blank lines appended
    id % 13 = 3  : a space and a tab before every line feed
    """
    return (
        F.when(doc_id % 7 == 1, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(doc_id % 11 == 2, F.concat(text, F.lit("  \n\n")))
        .when(doc_id % 13 == 3, F.replace(text, F.lit("\n"), F.lit(" \t\n")))
        .otherwise(text)
    )


# Blank captures (the table has none) are added as rows of their own: one, of
# blanks and line feeds only, beside every document with id % 101 = 5.
BLANK_ID_OFFSET = 1_000_000_000
BLANK_TEXT = " \n\t\n"

CAPTURED_TEXT_SQL = """CASE
    WHEN doc_id % 7 = 1 THEN replace(text, chr(10), chr(13) || chr(10))
    WHEN doc_id % 11 = 2 THEN text || '  ' || chr(10) || chr(10)
    WHEN doc_id % 13 = 3 THEN replace(text, chr(10), ' ' || chr(9) || chr(10))
    ELSE text END"""


def session_name(session_no: Column) -> Column:
    return F.format_string("nc-2024-01-%02d__09-00-00", session_no + 1)


def inventory(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """One row per captured document (M2).

    Columns: doc_id, session_id, session_no, session_order, is_current,
    is_organized, category, path, ctime, size, text (optional).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    blank = docs.filter(F.col("doc_id") % 101 == 5).select(
        (F.col("doc_id") + BLANK_ID_OFFSET).alias("doc_id"), F.lit(BLANK_TEXT).alias("text"), "lang", "source")
    docs = docs.unionByName(blank)
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    d = docs.join(labels.withColumn("is_organized", F.lit(True)), "doc_id", "left")
    session_no = F.substring(F.col("source"), 4, 10).cast("int")
    org = F.coalesce(F.col("is_organized"), F.lit(False))
    d = d.select(
        "doc_id",
        session_no.alias("session_no"),
        org.alias("is_organized"),
        F.col("lang").alias("category"),
        captured_text(F.col("doc_id"), F.col("text")).alias("text"),
    )
    sid = session_name(F.col("session_no"))
    path = F.concat_ws(
        "/",
        sid,
        F.when(F.col("is_organized"), F.concat(F.lit("organized/"), F.col("category"),
                                               F.lit("/doc"), F.col("doc_id").cast("string"),
                                               F.lit(".txt")))
        .otherwise(F.concat(F.lit("window"), F.lpad((F.col("doc_id") % 4 + 1).cast("string"), 2, "0"),
                            F.lit("/tab"), F.col("doc_id").cast("string"), F.lit(".txt"))),
    )
    cols = [
        "doc_id",
        sid.alias("session_id"),
        "session_no",
        # newest first: higher session number = newer session = smaller order
        (-F.col("session_no")).alias("session_order"),
        (F.col("session_no") >= CURRENT_FROM).alias("is_current"),
        "is_organized",
        "category",
        path.alias("path"),
        F.col("doc_id").alias("ctime"),
        F.octet_length("text").cast("long").alias("size"),
    ]
    if with_text:
        cols.append("text")
    return d.select(*cols)


INVENTORY_SQL = f"""
WITH lab AS (SELECT DISTINCT doc_id FROM labels),
d0 AS (
  SELECT doc_id, text, lang, source, (lab.doc_id IS NOT NULL) AS is_organized
  FROM (SELECT doc_id, text, lang, source FROM documents
        UNION ALL SELECT doc_id + {BLANK_ID_OFFSET}, ' ' || chr(10) || chr(9) || chr(10), lang, source
        FROM documents WHERE doc_id % 101 = 5) alldocs LEFT JOIN lab USING (doc_id)
),
d AS (
  SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS session_no, is_organized,
         lang AS category, {CAPTURED_TEXT_SQL} AS text
  FROM d0
)
SELECT doc_id,
       printf('nc-2024-01-%02d__09-00-00', session_no + 1) AS session_id,
       session_no, -session_no AS session_order, session_no >= {CURRENT_FROM} AS is_current,
       is_organized, category,
       printf('nc-2024-01-%02d__09-00-00', session_no + 1) || '/' ||
         CASE WHEN is_organized THEN 'organized/' || category || '/doc' || CAST(doc_id AS VARCHAR) || '.txt'
              ELSE 'window' || lpad(CAST(doc_id % 4 + 1 AS VARCHAR), 2, '0') || '/tab' || CAST(doc_id AS VARCHAR) || '.txt' END AS path,
       doc_id AS ctime, octet_length(encode(text)) AS size, text
FROM d
"""


# ---------------------------------------------------------------------------
# Captured tabs (E2), mapped onto ``conversations``
# ---------------------------------------------------------------------------
WINDOWS_PER_SESSION = 20  # a capture session holds conv_id div 20


# Variants of tabs (empty, with headers, copies) are added beside the given
# ones, as tabs before the first: turn -1 - turn.
def _tab_variant(conv: Column, turn: Column, text: Column, first_text: Column, prev_first: Column) -> Column:
    """Text of the variant added for a (window, tab); null: none."""
    lf = F.lit("\n")
    return (
        F.when((conv % 9 == 5) & (turn == 0), F.lit(""))
        .when((conv % 9 == 4) & (turn == 1), F.lit(""))
        .when((conv % 10 == 7) & (turn == 0), F.concat(F.lit("   "), lf, text))
        .when((conv % 8 == 3) & (turn == 0), F.concat(F.lit("# "), text))
        .when((conv % 8 == 5) & (turn == 0), F.concat(F.lit("[section]"), lf, text))
        .when((conv % 8 == 6) & (turn == 0), F.concat(F.lit("{"), text, F.lit("}")))
        .when((conv % 4 == 0) & (turn == 3), F.concat(first_text, F.lit("  \r\n")))
        .when((conv % 6 == 1) & (turn == 1), F.concat(prev_first, F.lit("\r\n")))
    )


def capture_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per captured tab: session_id, window_id, title, turn, phase,
    child_handle, text.

    window = conversation, tab = turn; phase 1 (already loaded, read silently,
    has a child handle) = role 'user', phase 2 (read by selecting the tab) =
    the other roles. The title is the first turn's first line + ' - Editor',
    starred (unsaved) for every third window.
    """
    from ..functions.text import first_line, pystrip

    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    firsts = conv.filter(F.col("turn") == 0).select("conv_id", F.col("text").alias("first_text"))
    prev = firsts.select((F.col("conv_id") + 1).alias("conv_id"), F.col("first_text").alias("prev_first"))
    c = conv.join(firsts, "conv_id", "left").join(prev, "conv_id", "left")
    variant = _tab_variant(F.col("conv_id"), F.col("turn"), F.col("text"), F.col("first_text"), F.col("prev_first"))
    tabs = F.array(F.struct(F.col("turn").cast("long").alias("turn"), "text"),
                   F.struct((-1 - F.col("turn")).cast("long").alias("turn"), variant.alias("text")))
    c = c.select("conv_id", "role", "first_text", F.posexplode(tabs).alias("added", "tab"))
    c = c.filter((F.col("added") == 0) | F.col("tab.text").isNotNull()).select(
        "conv_id", "role", "first_text", "tab.turn", "tab.text")
    title = F.concat(F.when(F.col("conv_id") % 3 == 0, F.lit("*")).otherwise(F.lit("")),
                     F.substring(pystrip(first_line(F.col("first_text"))), 1, 40), F.lit(" - Editor"))
    phase = F.when(F.col("role") == "user", F.lit(1)).otherwise(F.lit(2))
    return c.select(
        F.format_string("nc-2024-02-%02d__10-00-00", (F.col("conv_id") / WINDOWS_PER_SESSION).cast("int") + 1)
        .alias("session_id"),
        F.col("conv_id").alias("window_id"),
        title.alias("title"),
        "turn",
        phase.alias("phase"),
        F.when(phase == 1, F.col("conv_id") * 1000 + F.col("turn")).alias("child_handle"),
        "text",
    )


CAPTURE_TABS_SQL = f"""
WITH conv AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
firsts AS (SELECT conv_id, text AS first_text FROM conv WHERE turn = 0),
prev AS (SELECT conv_id + 1 AS conv_id, first_text AS prev_first FROM firsts),
j AS (SELECT conv.*, f.first_text, p.prev_first
      FROM conv LEFT JOIN firsts f ON conv.conv_id = f.conv_id LEFT JOIN prev p ON conv.conv_id = p.conv_id),
added AS (
  SELECT conv_id, -1 - turn AS turn, role, first_text,
    CASE
      WHEN conv_id % 9 = 5 AND turn = 0 THEN ''
      WHEN conv_id % 9 = 4 AND turn = 1 THEN ''
      WHEN conv_id % 10 = 7 AND turn = 0 THEN '   ' || chr(10) || text
      WHEN conv_id % 8 = 3 AND turn = 0 THEN '# ' || text
      WHEN conv_id % 8 = 5 AND turn = 0 THEN '[section]' || chr(10) || text
      WHEN conv_id % 8 = 6 AND turn = 0 THEN '{{' || text || '}}'
      WHEN conv_id % 4 = 0 AND turn = 3 THEN first_text || '  ' || chr(13) || chr(10)
      WHEN conv_id % 6 = 1 AND turn = 1 THEN prev_first || chr(13) || chr(10) END AS text
  FROM j),
c AS (SELECT conv_id, turn, role, first_text, text FROM j
      UNION ALL SELECT conv_id, turn, role, first_text, text FROM added WHERE text IS NOT NULL)
SELECT printf('nc-2024-02-%02d__10-00-00', CAST(trunc(conv_id / {WINDOWS_PER_SESSION}) AS INTEGER) + 1) AS session_id,
       conv_id AS window_id,
       (CASE WHEN conv_id % 3 = 0 THEN '*' ELSE '' END) || substr(@@STRIP_FIRST@@, 1, 40) || ' - Editor' AS title,
       turn, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS phase,
       CASE WHEN role = 'user' THEN conv_id * 1000 + turn END AS child_handle,
       text
FROM c
"""


# ---------------------------------------------------------------------------
# File listing (S2–S4, P12, P13): what a recursive scan of the search roots
# returns, derived from ``documents`` (session folders) and ``pages`` (other
# folders: look-alike names without a manifest, web captures, stray files).
# ---------------------------------------------------------------------------
ROOTS = 3
PAGE_FILE_NAMES = ["manifest.json", "_info.json", ".hidden", "page{id}.HTML", "page.exe", "page{id}",
                   "x.gitignore", "notes.MD", "img.png", "data.csv", "a.tar.gz", "script.PS1",
                   "readme.txt"]


def listed_session_name(session_no: Column) -> Column:
    """Every fourth session keeps the legacy folder name format."""
    day = F.format_string("%02d", session_no + 1)
    return F.when(session_no % 4 == 1, F.concat(F.lit(LEGACY_SESSION_PREFIX + "2024-01-"), day, F.lit("_09-00-00"))) \
        .otherwise(F.concat(F.lit("nc-2024-01-"), day, F.lit("__09-00-00")))


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, size, mtime of every file under the search roots."""
    inv = inventory(spark, sf_dir, with_text=False)
    root = F.concat(F.lit("/archive/r"), (F.col("session_no") % ROOTS).cast("string"))
    sdir = F.concat(root, F.lit("/"), listed_session_name(F.col("session_no")))
    rel = F.regexp_replace("path", "^[^/]+/", "")
    docs = inv.select(F.concat(sdir, F.lit("/"), rel).alias("path"), "size", F.col("ctime").alias("mtime"))
    sessions = inv.select("session_no").distinct()
    manifests = sessions.filter(F.col("session_no") % 7 != 6).select(
        F.concat(sdir, F.lit("/manifest.json")).alias("path"), F.lit(120).cast("long").alias("size"),
        F.lit(0).cast("long").alias("mtime"))
    infos = inv.filter(~F.col("is_organized")).select(
        "session_no", F.regexp_extract("path", "^[^/]+/(window[0-9]+)/", 1).alias("w")).distinct().select(
        F.concat(sdir, F.lit("/"), F.col("w"), F.lit("/_info.json")).alias("path"),
        F.lit(64).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    pages = table(spark, sf_dir, "pages").select("page_id")
    pid = F.col("page_id")
    day = F.format_string("%02d", pid % 28 + 1)
    pdir = (
        F.when(pid % 6 == 0, F.lit("nc-backups"))
        .when(pid % 6 == 1, F.lit("nc-scratch"))
        .when(pid % 6 == 2, F.lit("misc"))
        .when(pid % 6 == 3, F.concat(F.lit(LEGACY_SESSION_PREFIX + "2024-03-"), day, F.lit("_12-00-00")))
        .when(pid % 6 == 4, F.concat(F.lit("nc-2024-03-"), day, F.lit("__12-00-00")))
        .otherwise(F.concat(F.lit("nc-2024-03-"), day, F.lit("__12-00-00/organized/web")))
    )
    names = F.array(*[F.lit(n) for n in PAGE_FILE_NAMES])
    fname = F.replace(F.element_at(names, (pid % len(PAGE_FILE_NAMES) + 1).cast("int")), F.lit("{id}"),
                      pid.cast("string"))
    webs = pages.select(
        F.concat(F.lit("/archive/r"), (pid % ROOTS).cast("string"), F.lit("/"), pdir, F.lit("/"), fname).alias("path"),
        (pid * 37 % 5000).cast("long").alias("size"), pid.alias("mtime"))
    return docs.unionByName(manifests).unionByName(infos).unionByName(webs)


def _listed_session_sql(n: str) -> str:
    return (f"(CASE WHEN {n} % 4 = 1 THEN '{LEGACY_SESSION_PREFIX}2024-01-' || printf('%02d', {n} + 1) || '_09-00-00' "
            f"ELSE 'nc-2024-01-' || printf('%02d', {n} + 1) || '__09-00-00' END)")


def _page_names_sql() -> str:
    arr = ", ".join(f"'{n}'" for n in PAGE_FILE_NAMES)
    return f"replace([{arr}][page_id % {len(PAGE_FILE_NAMES)} + 1], '{{id}}', CAST(page_id AS VARCHAR))"


FILE_LISTING_SQL = f"""
inv AS ({INVENTORY_SQL}),
ls_docs AS (
  SELECT '/archive/r' || CAST(session_no % {ROOTS} AS VARCHAR) || '/' || {_listed_session_sql('session_no')} || '/'
         || regexp_replace(path, '^[^/]+/', '') AS path, size, ctime AS mtime FROM inv),
ls_sess AS (SELECT DISTINCT session_no FROM inv),
ls_man AS (
  SELECT '/archive/r' || CAST(session_no % {ROOTS} AS VARCHAR) || '/' || {_listed_session_sql('session_no')}
         || '/manifest.json' AS path, CAST(120 AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime
  FROM ls_sess WHERE session_no % 7 <> 6),
ls_info AS (
  SELECT '/archive/r' || CAST(session_no % {ROOTS} AS VARCHAR) || '/' || {_listed_session_sql('session_no')}
         || '/' || w || '/_info.json' AS path, CAST(64 AS BIGINT) AS size, CAST(0 AS BIGINT) AS mtime
  FROM (SELECT DISTINCT session_no, regexp_extract(path, '^[^/]+/(window[0-9]+)/', 1) AS w
        FROM inv WHERE NOT is_organized)),
ls_web AS (
  SELECT '/archive/r' || CAST(page_id % {ROOTS} AS VARCHAR) || '/' ||
    CASE page_id % 6 WHEN 0 THEN 'nc-backups' WHEN 1 THEN 'nc-scratch' WHEN 2 THEN 'misc'
      WHEN 3 THEN '{LEGACY_SESSION_PREFIX}2024-03-' || printf('%02d', page_id % 28 + 1) || '_12-00-00'
      WHEN 4 THEN 'nc-2024-03-' || printf('%02d', page_id % 28 + 1) || '__12-00-00'
      ELSE 'nc-2024-03-' || printf('%02d', page_id % 28 + 1) || '__12-00-00/organized/web' END
    || '/' || {_page_names_sql()} AS path,
    CAST(page_id * 37 % 5000 AS BIGINT) AS size, page_id AS mtime FROM pages),
listing AS (SELECT * FROM ls_docs UNION ALL SELECT * FROM ls_man UNION ALL SELECT * FROM ls_info
            UNION ALL SELECT * FROM ls_web)
"""
