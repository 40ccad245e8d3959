"""Column functions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Session folder name prefixes: an older one and the current "nc-"; a
# session folder name is a prefix followed by a date. Pass ``prefixes`` to
# ``session_of_path`` where folders are named otherwise.
LEGACY_SESSION_PREFIX = "session-"
SESSION_PREFIX = "nc-"
SESSION_NAME_REGEX = f"^({LEGACY_SESSION_PREFIX}|{SESSION_PREFIX})[0-9]{{4}}"
SESSION_GLOB_REGEX = f"^({LEGACY_SESSION_PREFIX}|{SESSION_PREFIX})"
# Extensions (lower case) accepted as text content; no extension is accepted too.
TEXT_EXTENSIONS = [
    ".txt", ".md", ".py", ".js", ".ts", ".json", ".xml", ".html", ".htm",
    ".css", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".csv",
    ".sh", ".bash", ".bat", ".cmd", ".ps1", ".psm1",
    ".c", ".cpp", ".h", ".hpp", ".java", ".go", ".rs", ".rb", ".pl",
    ".sql", ".r", ".lua", ".vim", ".gitignore", ".env",
    ".log", ".rst", ".tex", ".org",
]
MANIFEST_NAME = "manifest.json"
ORGANIZED_DIR = "organized"
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_parts(path) -> Column:
    return F.split(_col(path), "/")


def basename(path) -> Column:
    return F.element_at(path_parts(path), -1)


def parent(path) -> Column:
    parts = path_parts(path)
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def suffix(path) -> Column:
    """Lower-cased extension including the dot ('' when none)."""
    return F.regexp_extract(F.lower(basename(path)), "(\\.[^.]+)$", 1)


def is_content_file(path) -> Column:
    """S3: names starting '_' or '.', and manifest.json, are metadata; with an
    extension it must be a listed text extension; no extension is accepted."""
    name = F.lower(basename(path))
    ext = suffix(path)
    return (
        ~name.startswith("_")
        & ~name.startswith(".")
        & (name != MANIFEST_NAME)
        & ((ext == "") | ext.isin(TEXT_EXTENSIONS))
    )


def session_name_regex(prefixes) -> str:
    return f"^({'|'.join(prefixes)})[0-9]{{4}}"


def session_of_path(path, prefixes=(LEGACY_SESSION_PREFIX, SESSION_PREFIX)) -> Column:
    """The deepest path component (the file itself included) whose name
    starts with a session prefix and four digits; else the parent folder."""
    parts = path_parts(path)
    idx = F.array_max(F.transform(
        parts, lambda x, i: F.when(x.rlike(session_name_regex(prefixes)), i + 1)))
    return F.when(idx.isNotNull(), F.array_join(F.slice(parts, 1, idx), "/")).otherwise(parent(path))


def category_of_path(path) -> Column:
    """The part after the first 'organized' component (case-insensitive),
    else the file name."""
    parts = path_parts(path)
    pos = F.array_position(F.transform(parts, lambda x: F.lower(x)), ORGANIZED_DIR)
    tail = F.array_join(F.slice(parts, (pos + 1).cast("int"),
                                F.greatest(F.size(parts) - pos, F.lit(0)).cast("int")), "/")
    return F.when(pos > 0, tail).otherwise(basename(path))


def is_session_name(name) -> Column:
    return _col(name).rlike(SESSION_NAME_REGEX)
