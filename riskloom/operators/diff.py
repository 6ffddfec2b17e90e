"""Unified diffs: which file and line each added line belongs to.

The file is the last one that a header named; a line's number is counted within its segment, which a hunk header or a file header begins.
So a diff is cut at file headers, each part at hunk headers, and lines are numbered within an array: no row needs another one, and nothing is
shuffled. `positions` says the same of every line, by windows over the lines of a diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import LINE_END, bound, line_array, lines, lstrip_set, strip

_END = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_GAP, _WORD = rf"(?U:[\s&&[^{_END}]])", rf"(?U:[^\s{_END}])"
#: Lines that name a file: of a git header that has four words and more the fourth, of the other the rest.
_FILE = rf"diff --git {_GAP}*{_WORD}+{_GAP}+{_WORD}|\+\+\+ "
#: Hunk headers with a number after the first plus that a digit follows.
_HUNK = rf"@@ (?:(?!\+\d)[^{_END}])*+\+\d{{1,9}}(?!\d)"


def _cut(text: Column, at: str) -> Column:
    """A text at the line ends that a line beginning with `at` follows."""
    return F.split(text, rf"(?:{LINE_END})(?={at})")


def file_parts(diffs: DataFrame, key: str = "diff_id", text: str = "content", strict_paths: bool = False) -> DataFrame:
    """key, path, file (cleaned path), named (whether a header begins it), part, for each part of a diff on one file."""
    parts = diffs.select(key, F.explode(_cut(F.col(text), _FILE)).alias("part"))
    head = F.element_at(F.split("part", LINE_END, 2), 1)
    git = F.get(F.split(strip(head), r"(?U)\s+"), F.lit(3))
    named = F.col("part").rlike(rf"\A(?:{_FILE})")
    path = F.when(named, F.when(head.startswith("+++ "), strip(F.substring(head, 5, 1 << 30))).otherwise(git)).otherwise(F.lit(""))
    return parts.select(key, path.alias("path"), _clean(path, strict_paths).alias("file"), named.alias("named"), "part")


def added_array(part: Column, count_context: bool = False) -> Column:
    """Of a part of a diff its added lines: an array of (line_num, line, added), the line without its plus."""
    plus = lambda x: x.startswith("+") & ~x.startswith("+++")
    counted = (lambda x: plus(x) | x.startswith(" ")) if count_context else plus

    def of_segment(segment: Column) -> Column:
        base = F.when(segment.rlike(rf"\A{_HUNK}"), F.regexp_extract(segment, r"\+(\d+)", 1).cast("int") - 1).otherwise(F.lit(0))

        def numbered(start: Column) -> Column:
            rest = lambda x: F.substring(x, 2, 1 << 30).alias("line")
            return F.transform(F.filter(line_array(segment), counted), lambda x, i: F.struct((start + i + 1).alias("line_num"), rest(x), x.startswith("+").alias("added")))

        # The start is read for every line, and made once.
        made = bound(base, numbered)
        return F.filter(made, lambda x: x["added"]) if count_context else made

    return F.flatten(F.transform(_cut(part, _HUNK), of_segment))


def added_line_count(diffs: DataFrame, text: str = "content", *keys: str) -> DataFrame:
    """Lines that begin with + but not with +++, whatever their file."""
    plus = F.col("line").startswith("+") & ~F.col("line").startswith("+++")
    return lines(diffs, text, *keys).groupBy(*keys).agg(F.count_if(plus).alias("lines_scanned"))


def _clean(path: Column, strict: bool) -> Column:
    """Without leading b and / characters, as many as there are (strict: without one leading b/)."""
    return F.regexp_replace(path, "^b/", "") if strict else lstrip_set(path, "b/")


def positions(diffs: DataFrame, key: str = "diff_id", text: str = "content", strict_paths: bool = False, count_context: bool = False) -> DataFrame:
    """A row for each line of each diff: key, i, raw, path, file (cleaned path), is_added, line_num, is_header.

    A header `diff --git` names the fourth of its words, `+++ ` the rest of its line; both set the counter to 0, and `@@` sets it to
    one less than the first number after a plus. Added lines count (count_context: lines of context too).
    """
    raw = lines(diffs, text, key, first=0).select(key, F.col("line_num").alias("i"), F.col("line").alias("raw"))
    words = F.split(strip(F.col("raw")), r"(?U)\s+")
    git, plus, hunk = F.col("raw").startswith("diff --git "), F.col("raw").startswith("+++ "), F.col("raw").startswith("@@ ")
    named = F.when(git, F.when(F.size(words) >= 4, F.get(words, F.lit(3)))).when(plus, strip(F.substring("raw", 5, 1 << 30)))
    start = F.try_to_number(F.regexp_extract("raw", r"\+(\d+)", 1), F.lit("9999999999")).cast("int") - 1
    base = F.when(named.isNotNull(), F.lit(0)).when(~git & hunk, start)
    added = ~git & ~plus & ~hunk & F.col("raw").startswith("+") & ~F.col("raw").startswith("+++")
    marked = raw.withColumns({"named": named, "base": base, "is_added": added, "is_header": git | plus})
    counted = F.col("is_added") | (F.col("raw").startswith(" ") if count_context else F.lit(False))
    marked = marked.withColumn("counted", counted)
    along = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = marked.withColumns({"path": F.last("named", ignorenulls=True).over(along), "segment": F.count("base").over(along)})
    within = W.partitionBy(key, "segment").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    number = F.coalesce(F.first("base").over(within), F.lit(0)) + F.sum(F.col("counted").cast("int")).over(within)
    out = seen.withColumn("line_num", number.cast("int"))
    path = F.coalesce("path", F.lit(""))
    return out.select(key, "i", "raw", path.alias("path"), _clean(path, strict_paths).alias("file"), "is_added", "is_header", "line_num")
