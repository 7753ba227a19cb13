"""Scalar text functions as composed Spark expressions (no Python in the row path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The delimiter set, as the inside of a character class.
DELIMITERS = r" \t\n\r\[\]{}(),:=;<>/\\|\-#"

# The same templates as a lexer: a quoted run, a run of delimiters, or a token. The three
# cover every character, so joining mapped lexemes rebuilds the message. The checks use it.
LEXEME = (
    r'"[^"]*(?:"|\z)' r"|'[^']*(?:'|\z)" rf"|[{DELIMITERS}]+" rf"|[^{DELIMITERS}\"'][^{DELIMITERS}]*"
)

_START = rf"(?<![^{DELIMITERS}])"
# Quoted runs open where a lexeme starts: after a delimiter or right after another run
# (``\G``); a quote inside a token opens nothing. The markers are set off by delimiters
# and hold no digit, so after the first pass a token is any run without delimiters.
_QUOTED = rf"(?:\G|(?<=[{DELIMITERS}]))(?:\"[^\"]*(?:\"|\z)|'[^']*(?:'|\z))"
_HEX = rf"{_START}0[xX][^{DELIMITERS}]*+"
_DECIMAL = rf"{_START}\.*+[0-9][0-9.]*+(?![^{DELIMITERS}])"
_WITH_DIGIT = rf"{_START}[^{DELIMITERS}0-9]*+[0-9][^{DELIMITERS}]*+"


def _has(text: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def fingerprint(message: Column) -> Column:
    """Template of a log message: variable parts become ``<STR> <HEX> <NUM> <*>``.

    Up to four replacements, each linear in the text; the first two are skipped for
    messages whose bytes show that there is nothing to replace.
    """
    no_quotes = F.when(_has(message, '"', "'"), F.regexp_replace(message, _QUOTED, "<STR>")).otherwise(message)
    no_hex = F.when(_has(message, "0x", "0X"), F.regexp_replace(no_quotes, _HEX, "<HEX>")).otherwise(no_quotes)
    return F.regexp_replace(F.regexp_replace(no_hex, _DECIMAL, "<NUM>"), _WITH_DIGIT, "<*>")


NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def to_number(text: Column) -> Column:
    """Finite double from text, else NULL (Java's own ``1d`` and ``NaN`` are refused)."""
    return F.when(text.rlike(rf"\A{NUMBER}\z"), text.try_cast("double"))


def size_to_bytes(text: Column) -> Column:
    """``1.2M`` to bytes; powers of 1024, upper-case suffix, optional ``B``."""
    trimmed = F.trim(text)
    pattern = rf"\A({NUMBER})([KMGT]?)B?\z"
    number = F.regexp_extract(trimmed, pattern, 1).try_cast("double")
    unit = F.regexp_extract(trimmed, pattern, 2)
    factor = (
        F.when(unit == "K", F.lit(1024.0))
        .when(unit == "M", F.lit(1024.0**2))
        .when(unit == "G", F.lit(1024.0**3))
        .when(unit == "T", F.lit(1024.0**4))
        .otherwise(F.lit(1.0))
    )
    return F.when(trimmed == "", F.lit(0).cast("bigint")).otherwise((number * factor).cast("bigint"))


def format_bytes(value: Column) -> Column:
    """Bytes with two digits (ties to even) and the largest fitting binary unit."""
    cases = None
    for power, unit in ((6, "EB"), (5, "PB"), (4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        size = float(1024**power)
        text = F.format_string(f"%.2f {unit}", F.bround(value.cast("double") / F.lit(size), 2))
        cases = (cases.when if cases is not None else F.when)(value >= F.lit(size), text)
    return cases.otherwise(F.format_string("%.0f B", value.cast("double")))


def format_ms(value: Column) -> Column:
    """Milliseconds as ms, s, m+s or h+m."""
    seconds = value.cast("double") / 1000
    minutes = seconds / 60
    hours = minutes / 60
    return (
        F.when(value < 1000, F.format_string("%.2f ms", value.cast("double")))
        .when(seconds < 60, F.format_string("%.2f s", seconds))
        .when(
            minutes < 60,
            F.format_string("%dm %.2fs", minutes.cast("int"), seconds - F.floor(minutes) * 60),
        )
        .otherwise(F.format_string("%dh %.2fm", hours.cast("int"), minutes - F.floor(hours) * 60))
    )


def percent(value: Column, total: Column) -> Column:
    """Share in percent; 0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(value / total * 100)


def version_parts(version: Column) -> Column:
    """``v25.1.5`` to ``[25, 1, 5]``; a part that is no number counts 0."""
    parts = F.split(F.regexp_replace(version, "^v", ""), r"\.")
    return F.transform(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def version_at_least(version: Column, target: str | Column) -> Column:
    """Numeric comparison part by part; on a tie the longer version is the greater."""
    other = F.lit(target) if isinstance(target, str) else target
    return version_parts(version) >= version_parts(other)


def is_public_address(host: Column) -> Column:
    """IPv4 literal outside the private and carrier-grade ranges."""
    parts = F.split(host, r"\.")
    first = F.coalesce(F.get(parts, 0).try_cast("int"), F.lit(0))
    second = F.coalesce(F.get(parts, 1).try_cast("int"), F.lit(0))
    private = (
        (first == 10)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
        | ((first == 100) & second.between(64, 127))
    )
    local = host.isin("", "localhost", "127.0.0.1", "::1") | host.endswith(".local")
    return F.coalesce(~local & (F.size(parts) == 4) & ~private, F.lit(False))


def address_port(address: Column) -> Column:
    return F.substring_index(address, ":", -1)


def topic_of(ntp: Column) -> Column:
    """Second part of ``ns/topic/partition``."""
    return F.get(F.split(ntp, "/"), 1)


# Fixed value: path of a log segment below the data directory.
SEGMENT_PATH = r"/kafka/([^/]+)/(\d+)_(\d+)/[^/]+\.log\z"


def segment_path(path: Column) -> Column:
    """Struct (data_dir, topic, partition_id, revision); fields NULL for other files."""
    hit = path.rlike(SEGMENT_PATH)
    return F.struct(
        F.when(hit, F.substring_index(path, "/kafka/", 1)).alias("data_dir"),
        F.when(hit, F.regexp_extract(path, SEGMENT_PATH, 1)).alias("topic"),
        F.when(hit, F.regexp_extract(path, SEGMENT_PATH, 2).cast("bigint")).alias("partition_id"),
        F.when(hit, F.regexp_extract(path, SEGMENT_PATH, 3).cast("bigint")).alias("revision"),
    )


def irq_base_device(device: Column) -> Column:
    """Queue name to device: ``nvme0q1`` to ``nvme0``, ``eth0-TxRx-0`` to ``eth0``."""
    nvme = F.regexp_extract(device, "^(nvme[^q]*)q", 1)
    return F.when(nvme != "", nvme).otherwise(F.substring_index(device, "-", 1))


def selected_option(text: Column) -> Column:
    """The bracketed word of ``always [madvise] never``, else ``unknown``."""
    word = F.regexp_extract(text, r"(?:^|\s)\[(\S*)\](?:\s|$)", 1)
    return F.when(word != "", word).otherwise(F.lit("unknown"))


def series_label(labels: Column) -> Column:
    """Sorted ``k=v, k=v`` of a label map; ``value`` when there are none."""
    entries = F.sort_array(F.map_entries(labels))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.when(labels.isNull() | (F.size(labels) == 0), F.lit("value")).otherwise(text)


def html_escape(text: Column) -> Column:
    """The five characters that a page must not take literally."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"))
    return reduce(lambda col, pair: F.replace(col, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def highlight(text: Column, terms: list[str]) -> Column:
    """Escaped text with every hit of a term, in any case, inside ``<mark>``."""
    import re

    shown = html_escape(text)
    words = [t for t in terms if t]
    if not words:
        return shown
    escape = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"})
    longest_first = sorted({w.translate(escape) for w in words}, key=lambda w: (-len(w), w))
    pattern = "(?i)(" + "|".join(re.escape(w) for w in longest_first) + ")"
    return F.regexp_replace(shown, pattern, "<mark>$1</mark>")


def snippet(text: Column, term: str, width: int = 50) -> Column:
    """The first hit with up to ``width`` characters on either side."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - F.lit(width), F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + F.lit(len(term) + width)))


def json_path(path: str) -> str:
    """``a.b.[0].c`` to ``$.a.b[0].c``; a name written before ``[`` in one part is ignored."""
    out = "$"
    for part in filter(None, path.split(".")):
        if "[" in part and part.endswith("]"):
            out += part[part.index("["):]
        else:
            out += f"['{part}']"
    return out


def json_at(document: Column, path: str) -> Column:
    """Value at a path of a JSON text; NULL when missing."""
    return F.get_json_object(document, json_path(path)) if path else document


def json_children(document: Column, offset: int, limit: int) -> Column:
    """One page of an array's items or of an object's sorted keys."""
    items = F.from_json(document, "array<string>")
    keys = F.array_sort(F.json_object_keys(document))
    listed = F.when(F.ltrim(document).startswith("["), items).otherwise(keys)
    return F.slice(listed, offset + 1, limit)
