"""Column functions on document text (all JVM-side, codegen friendly).

Every function takes and returns a ``Column`` so it composes inside one
projection; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being reproduced)
# ---------------------------------------------------------------------------
# Python's str.isspace() set as a Java regex character class (29 code points):
# U+0009-U+000D, U+001C-U+0020, U+0085, U+00A0, U+1680, U+2000-U+200A,
# U+2028, U+2029, U+202F, U+205F, U+3000.
WS_CLASS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# The same set without the line feed (per-line right strip).
WS_LINE_CLASS = "[\\t\\x0b-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Substrings that mark a text as code when found in its first 500 characters,
# in the order they are tested.
CODE_INDICATORS = [
    "import ", "from ", "def ", "class ", "function ", "const ",
    "var ", "let ", "#include", "#!/", "package ", "public class",
]
# Characters replaced by "_" in file names: < > : " / \ | ? * and \x00-\x1f.
FILENAME_BAD_CHARS = '[<>:"/\\\\|?*\\x00-\\x1f]'
TAB_LABEL_MAX = 60
FILENAME_MAX = 60
TYPE_SCAN_CHARS = 500
SHORT_NOTE_CHARS = 200
# ---------------------------------------------------------------------------
# Runs of white space at a line's or the text's end. The look-behind lets a
# match start only at a run's first character and the possessive quantifier
# never gives characters back, so a run is passed over once: linear time.
_LINE_TAIL = f"(?<!{WS_LINE_CLASS}){WS_LINE_CLASS}++(?=\\n|\\z)"
_TEXT_TAIL = f"(?<!{WS_CLASS}){WS_CLASS}++\\z"
_EMPTY_TAIL = "(?<!\\n)\\n++\\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """``str.strip()``: both ends, Python whitespace."""
    return F.regexp_replace(_col(c), f"^{WS_CLASS}++|{_TEXT_TAIL}", "")


def pyrstrip(c) -> Column:
    """``str.rstrip()``."""
    return F.regexp_replace(_col(c), _TEXT_TAIL, "")


def unify_newlines(c) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(_col(c), "\\r\\n?", "\n")


def normalize_text(c) -> Column:
    """Unify line ends, right-strip every line, drop trailing empty lines.

    Leading blank lines are kept. Null stays null.
    """
    s = unify_newlines(c)
    s = F.regexp_replace(s, _LINE_TAIL, "")
    return F.regexp_replace(s, _EMPTY_TAIL, "")


def content_hash(c) -> Column:
    """SHA-256 hex of the normalised text's UTF-8 bytes."""
    return F.sha2(normalize_text(c), 256)


def sha256_hex(c) -> Column:
    """SHA-256 of an already normalised string or of raw bytes."""
    return F.sha2(_col(c), 256)


def capture_key(c) -> Column:
    """The capture normaliser (per-line right strip, then strip both ends).

    Null or empty input gives ''. The key itself is the SHA-256 of this text,
    a deterministic replacement for a process-local hash().
    """
    s = F.regexp_replace(unify_newlines(c), _LINE_TAIL, "")
    s = pystrip(s)
    return F.coalesce(s, F.lit(""))


def capture_hash(c) -> Column:
    return F.sha2(capture_key(c), 256)


def is_blank(c) -> Column:
    """The (normalised) text is empty after stripping Python whitespace."""
    return F.length(pystrip(c)) == 0


def first_line(c) -> Column:
    return F.substring_index(_col(c), "\n", 1)


def tab_label(c, max_len: int = TAB_LABEL_MAX) -> Column:
    """Label of a tab from its first line."""
    t = _col(c)
    line = pystrip(F.regexp_replace(first_line(t), "\\r", ""))
    return (
        F.when(t.isNull() | (t == ""), F.lit("(empty)"))
        .when(line == "", F.lit("(whitespace only)"))
        .otherwise(F.substring(line, 1, max_len))
    )


def detect_file_type(c) -> Column:
    """P5: ordered classifier empty → config → code → data → markdown →
    short-note → text."""
    t = _col(c)
    line = pystrip(first_line(t))
    head = F.substring(t, 1, TYPE_SCAN_CHARS)
    stripped = pystrip(t)
    is_code = F.lit(False)
    for ind in CODE_INDICATORS:
        is_code = is_code | head.contains(ind)
    is_data = (stripped.startswith("{") & stripped.endswith("}")) | (
        stripped.startswith("[") & stripped.endswith("]")
    )
    return (
        F.when(t.isNull() | (F.length(stripped) == 0), F.lit("empty"))
        .when(line.startswith("[") & line.contains("]"), F.lit("config"))
        .when(is_code, F.lit("code"))
        .when(is_data, F.lit("data"))
        .when(line.startswith("# ") | head.contains("\n## "), F.lit("markdown"))
        .when(F.length(t) < SHORT_NOTE_CHARS, F.lit("short-note"))
        .otherwise(F.lit("text"))
    )


def sanitize_filename(c, max_len: int = FILENAME_MAX) -> Column:
    """Unsafe characters → '_', strip '.' and ' ' at both ends, then cut."""
    s = F.regexp_replace(_col(c), FILENAME_BAD_CHARS, "_")
    s = F.regexp_replace(s, "^[. ]+|[. ]+\\z", "")
    s = F.substring(s, 1, max_len)
    return F.when(s == "", F.lit("unnamed")).otherwise(s)


def clean_tab_name(c) -> Column:
    """Drop the '. Modified.' / '. Unmodified.' suffix text and strip."""
    s = F.replace(F.replace(_col(c), F.lit(". Modified."), F.lit("")), F.lit(". Unmodified."), F.lit(""))
    return pystrip(s)


def has_unsaved(title) -> Column:
    """A window title starting with '*' has unsaved changes."""
    return _col(title).startswith("*")


def read_method(child_handle) -> Column:
    """P14: 'silent' when the tab was read from a loaded child, else 'select'."""
    return F.when(_col(child_handle).isNotNull(), F.lit("silent")).otherwise(F.lit("select"))


def code_points(c) -> Column:
    """Text length in Unicode code points (Spark length() counts code points)."""
    return F.length(_col(c))
