"""DuckDB spellings of the column functions, used by the oracle SQL.

RE2 has no look-ahead, so the per-line strip of the normaliser splits the text
into lines and strips each one.
"""

from __future__ import annotations

from ..functions.paths import SESSION_NAME_REGEX
from ..functions.text import CODE_INDICATORS, SHORT_NOTE_CHARS, TYPE_SCAN_CHARS
from ..functions.threshold import DEFAULT_CURVE

WS = "[\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
WS_LINE = "[\\t\\x{0b}-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
LF = "chr(10)"
CR = "chr(13)"


def unify(e: str) -> str:
    return f"replace(replace({e}, {CR} || {LF}, {LF}), {CR}, {LF})"


def rstrip_lines(e: str) -> str:
    return (f"array_to_string(list_transform(string_split({e}, {LF}), "
            f"lambda x: regexp_replace(x, '{WS_LINE}+$', '')), {LF})")


def norm(e: str) -> str:
    return f"regexp_replace({rstrip_lines(unify(e))}, '\\n+$', '')"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g')"


def is_blank(e: str) -> str:
    return f"(length({strip(e)}) = 0)"


def capture_key(e: str) -> str:
    return f"coalesce({strip(rstrip_lines(unify(e)))}, '')"


def first_line(e: str) -> str:
    return f"split_part({e}, {LF}, 1)"


def tab_label(e: str) -> str:
    line = strip(f"replace({first_line(e)}, {CR}, '')")
    return (f"(CASE WHEN {e} IS NULL OR {e} = '' THEN '(empty)' "
            f"WHEN {line} = '' THEN '(whitespace only)' ELSE substr({line}, 1, 60) END)")


def file_type(e: str) -> str:
    line = strip(first_line(e))
    head = f"substr({e}, 1, {TYPE_SCAN_CHARS})"
    st = strip(e)
    code = " OR ".join(f"contains({head}, '{i}')" for i in CODE_INDICATORS)
    return (
        f"(CASE WHEN {e} IS NULL OR length({st}) = 0 THEN 'empty' "
        f"WHEN starts_with({line}, '[') AND contains({line}, ']') THEN 'config' "
        f"WHEN {code} THEN 'code' "
        f"WHEN (starts_with({st}, '{{') AND ends_with({st}, '}}')) OR (starts_with({st}, '[') AND ends_with({st}, ']')) THEN 'data' "
        f"WHEN starts_with({line}, '# ') OR contains({head}, {LF} || '## ') THEN 'markdown' "
        f"WHEN length({e}) < {SHORT_NOTE_CHARS} THEN 'short-note' ELSE 'text' END)"
    )


def sanitize(e: str) -> str:
    s = f"regexp_replace({e}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g')"
    s = f"substr(regexp_replace({s}, '^[. ]+|[. ]+$', '', 'g'), 1, 60)"
    return f"(CASE WHEN {s} = '' THEN 'unnamed' ELSE {s} END)"


def threshold(e: str, curve=DEFAULT_CURVE) -> str:
    return curve.sql(e)


def basename(e: str) -> str:
    return f"(string_split({e}, '/'))[-1]"


def session_of_path(e: str) -> str:
    parts = f"string_split({e}, '/')"
    idx = (f"list_max(list_transform(generate_series(1, len({parts})), "
           f"lambda i: CASE WHEN regexp_matches({parts}[i], '{SESSION_NAME_REGEX}') THEN i END))")
    return (f"(CASE WHEN {idx} IS NOT NULL THEN array_to_string({parts}[1:{idx}], '/') "
            f"ELSE array_to_string({parts}[1:len({parts}) - 1], '/') END)")


def category_of_path(e: str) -> str:
    parts = f"string_split({e}, '/')"
    pos = f"list_position(list_transform({parts}, lambda x: lower(x)), 'organized')"
    return (f"(CASE WHEN coalesce({pos}, 0) > 0 THEN array_to_string({parts}[{pos} + 1:], '/') "
            f"ELSE {basename(e)} END)")
