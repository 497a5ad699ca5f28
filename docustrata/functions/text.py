"""Scalar functions over text columns. Nulls give null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import SPACE, spark

_GUID = r"\{?([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12})\}?"


def js_trim(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, rf"^{SPACE}+|{SPACE}+\z", "")


def lines(x: Column) -> Column:
    """Array of lines, parted by LF or CRLF; an empty text is one empty line."""
    return F.split(x, r"\r?\n", -1)


def safe_file_name(x: Column) -> Column:
    """Runs of characters other than ASCII letters, digits, ``._-`` become ``_``; at most 180 characters; ``stream`` when nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+\z", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, 180), F.lit("")), F.lit("stream"))


def normalize_identifier(x: Column) -> Column:
    """Lower case, without a note in brackets at the end and anything but ASCII letters, digits and ``_``."""
    return F.lower(F.regexp_replace(F.regexp_replace(x, rf"{SPACE}+\(.+\)\z", ""), r"[^A-Za-z0-9_]", ""))


def normalize_guid(x: Column) -> Column:
    """The first GUID in a text as ``{UPPER}``; null where there is none."""
    found = F.regexp_extract(x, _GUID, 1)
    return F.when(found != "", F.concat(F.lit("{"), F.upper(found), F.lit("}")))


def bound(x: Column, f) -> Column:
    """``f`` of a value that is made once a row, however often ``f`` names it: it is the one element of a list around it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


#: What a caption is made of, and what is none though made of it. Fixed values.
HUMAN = r"[A-Za-z0-9_ .'-]{2,80}"
NOT_HUMAN = (r"^Forms\.", "Embedded Object", "Microsoft Forms", r"^Tahoma$", r"^0x[0-9a-f]+$", r"^\{[0-9A-F-]+\}$", "^'", r"^[-=]{5,}$", r"https?://", "copyright|permission is hereby")


def is_human_label(x: Column) -> Column:
    """Whether a text looks like a caption someone wrote, not an identifier, rule line, licence or address."""
    plain = F.regexp_replace(x, rf"{SPACE}+\(.+\)\z", "")
    return bound(plain, lambda p: F.rlike(p, F.lit(rf"\A{HUMAN}\z")) & ~F.rlike(p, F.lit("(?i)" + "|".join(NOT_HUMAN))))


def truncate_label(x: Column, most: int) -> Column:
    """At most ``most`` characters; a longer text ends in three dots."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, max(0, most - 3)), F.lit("..."))).otherwise(x)


def escape_xml(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def escape_html(x: Column) -> Column:
    return F.replace(escape_xml(x), F.lit("'"), F.lit("&#39;"))


def format_bytes(n: Column) -> Column:
    """As B, KB or MB, the latter with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024 / 1024))


def to_hex(n: Column, width: int = 4) -> Column:
    """``0x`` and upper-case hexadecimal digits, at least ``width``."""
    digits = F.hex(n)
    return F.concat(F.lit("0x"), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def graph_node_id(x: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(x, r"[^A-Za-z0-9_]", "_"))


def mermaid_label(x: Column) -> Column:
    return F.replace(x, F.lit('"'), F.lit("'"))


def title_case(x: Column) -> Column:
    """Upper-cases the first letter of every ASCII word and leaves the rest."""
    parts = F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def count_label(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def parse_number(x: Column) -> Column:
    """The number a text begins with; null where it begins with none."""
    digits = rf"^{SPACE}*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"
    return F.nullif(F.regexp_extract(x, digits, 1), F.lit("")).try_cast("double")


def strip_confidence(x: Column) -> Column:
    """Without a trailing ``(high)``, ``(medium)`` or ``(low)``."""
    return F.regexp_replace(x, spark(r"\s*\((?:high|medium|low)\)\z"), "")


def confidence(x: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(x, r"(?i)\((high|medium|low)\)\z", 1)), F.lit(""))


def split_value(line: Column) -> Column:
    """What stands between the first and the second ``=`` of a line."""
    return F.split_part(line, F.lit("="), F.lit(2))


def hex_pairs(x: Column) -> Column:
    """The bytes of a binary or text column as two-digit hexadecimal strings."""
    return F.regexp_extract_all(F.hex(x), F.lit("[0-9A-F]{2}"), F.lit(0))
