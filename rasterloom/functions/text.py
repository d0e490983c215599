"""Number, path and label formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / 1048576.0))
    )


def format_count(n: Column) -> Column:
    return F.format_number(n, 0)


def format_percent(share: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100.0)


def short_number(v: Column, digits: int = 2) -> Column:
    """Fixed decimals without trailing zeros, a leading zero or a negative zero; 0 if not finite."""
    text = F.round(v.cast("decimal(38,18)"), digits).cast(f"decimal(30,{digits})").cast("string")
    text = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if digits else text
    text = F.when(text.isin("-0", ""), "0").otherwise(F.regexp_replace(text, r"^(-?)0\.", "$1."))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "0").otherwise(text)


def escape_attribute(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def join_tokens(tokens: Column) -> Column:
    """Tokens with a space only between two numbers of which the second has no sign."""
    return F.regexp_replace(F.regexp_replace(F.array_join(tokens, " "), "(?<=[A-Za-z]) | (?=[A-Za-z])", ""), " (?=-)", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def with_extension(path: Column, ext: str) -> Column:
    swapped = F.regexp_replace(path, r"\.[^./]*$", "." + ext)
    return F.when(path.rlike(r"\.[^./]*$"), swapped).otherwise(F.concat(path, F.lit("." + ext)))


def swap_extension(name: Column, ext: str) -> Column:
    """The base name with another extension; ``artwork`` where nothing is left of it."""
    base = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("artwork")), F.lit("." + ext))


def truncate_head(text: Column, length: int) -> Column:
    """The end of a long text after an ellipsis."""
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.lit("…"), F.right(text, F.lit(length - 1))))


def format_milliseconds(ms: Column) -> Column:
    """Whole milliseconds under a second, else seconds with two decimals."""
    return F.when(ms < 1000, F.format_string("%dms", F.floor(ms + 0.5))).otherwise(F.format_string("%.2fs", ms / 1000.0))


def clamp_int(v: Column, low: int, high: int) -> Column:
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.when(ok, F.greatest(F.lit(low), F.least(F.lit(high), F.floor(v + 0.5)))).otherwise(F.lit(low)).cast("int")


def output_bytes(text: Column, format: str) -> Column:
    """A document's bytes: PDF as Latin-1, whose offsets count bytes, all else as UTF-8."""
    return F.encode(text, "ISO-8859-1" if format == "pdf" else "UTF-8")
