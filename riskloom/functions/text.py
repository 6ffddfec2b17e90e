"""Expressions on lines and paths. All of them are built-in functions, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Python's splitlines takes as a line's end.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
_COMMENT = r"^(?:#|//|/\*|\*|<!--|-->|--|;|REM |rem )"
#: What stands before an inline comment. Quantifiers are possessive: no backtracking, and no deep stack on very long lines.
_CODE = r"""(?s)^((?:[^'"`\\#/\-]|\\.|'(?:[^'\\]|\\.)*+'|"(?:[^"\\]|\\.)*+"|`(?:[^`\\]|\\.)*+`|/(?!/)|-(?!-))*+)(?:#|//|--).*$"""


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value made once however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def line_array(text: Column) -> Column:
    """The lines of a text. One that ends a line doesn't begin another; an empty text has none."""
    return bound(F.split(text, LINE_END), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def lines(df: DataFrame, text: str, *keep: str, first: int = 1) -> DataFrame:
    """A row for each line of `text`: the columns in keep, line_num, line."""
    out = df.select(*keep, F.posexplode(line_array(F.col(text))).alias("line_num", "line"))
    return out.withColumn("line_num", F.col("line_num") + F.lit(first))


def line_count(text: Column) -> Column:
    """Lines of a text, without exploding it."""
    return bound(F.split(text, LINE_END), lambda parts: F.size(parts) - (F.element_at(parts, -1) == "").cast("int"))


def is_comment_line(c: Column) -> Column:
    """Blank, or beginning with a comment sign."""
    line = strip(c)
    return (line == "") | line.rlike(_COMMENT)


def strip_inline_comment(c: Column) -> Column:
    """Cut at the first #, // or -- outside quotes; a backslash takes the next character with it. Unclosed quotes leave the line as it is."""
    return F.when(c.rlike(_CODE), rstrip(F.regexp_extract(c, _CODE, 1))).otherwise(c)


def mask(c: Column) -> Column:
    """Runs of 12 and more word characters become their first four, three dots and their last four."""
    return F.regexp_replace(c, r"([A-Za-z0-9_\-]{4})[A-Za-z0-9_\-]{4,}([A-Za-z0-9_\-]{4})", "$1...$2")


def snippet(c: Column, width: int = 80) -> Column:
    return F.substring(mask(c), 1, width)


def severity_rank(c: Column, unknown: int = 1) -> Column:
    from ..operators.rules import SEVERITIES

    out = F.lit(unknown)
    for i, s in enumerate(SEVERITIES):
        out = F.when(F.upper(c) == s, F.lit(i)).otherwise(out)
    return out


def severity_of(c: Column) -> Column:
    """A severity by name, in any case; LOW if it is none."""
    from ..operators.rules import SEVERITIES

    return F.when(F.upper(c).isin(*SEVERITIES), F.upper(c)).otherwise(F.lit("LOW"))


def location(file: Column, line: Column, column: Column) -> Column:
    """file, file:line or file:line:column; line 0 stands for the whole file."""
    return F.when(line > 0, F.when(column.isNotNull(), F.concat_ws(":", file, line, column)).otherwise(F.concat_ws(":", file, line))).otherwise(file)


def confidence_text(c: Column) -> Column:
    return F.when((c >= 0) & (c <= 1), F.concat((c * 100).cast("int").cast("string"), F.lit("%"))).otherwise(F.concat(c.cast("string"), F.lit("%")))


def score_text(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit("N/A")).otherwise(F.format_string("%.1f", c))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def lstrip_set(c: Column, characters: str) -> Column:
    return F.ltrim(c, F.lit(characters))
