"""Column builders over code and text lines (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = " \t\n\r\x0b\x0c"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(WS))


def is_comment(line: Column) -> Column:
    """Line that, stripped and without blanks, starts like a comment or ends one."""
    x = F.replace(strip(line), F.lit(" "), F.lit(""))
    return x.startswith("//") | x.startswith("/*") | x.startswith("*") | x.endswith("*/")


def short_hash(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(8))


def name_parts(full: Column) -> Column:
    """``a.b.C.m(int)`` → struct(class_full, class, method)."""
    plain = F.regexp_replace(full, r"\(.*\)", "")
    parts = F.split(plain, r"\.")
    n = F.size(parts)
    class_full = F.when(n > 1, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(1))), "."))
    return F.struct(class_full.alias("class_full"), F.get(parts, n - 2).alias("class"), F.get(parts, n - 1).alias("method"))


def hunk_lines(changes: Column) -> Column:
    """Texts of a nullable array of line changes."""
    return F.coalesce(F.transform(changes, lambda c: c["line"]), F.array().cast("array<string>"))


def hunk_text(source: Column, target: Column) -> Column:
    """``- a + b`` form of a hunk's lines."""
    parts = F.concat(F.transform(source, lambda x: F.concat(F.lit(" - "), x)), F.transform(target, lambda x: F.concat(F.lit(" + "), x)))
    return strip(F.array_join(parts, ""))


def hunk_location(source: Column, target: Column) -> Column:
    """``(first source line:first target line)`` with ``null`` for a missing side."""
    first = lambda c: F.coalesce(F.get(F.transform(c, lambda x: x["lineNo"]), F.lit(0)).cast("string"), F.lit("null"))
    return F.concat(F.lit("("), first(source), F.lit(":"), first(target), F.lit(")"))


def base_document(source: Column, target: Column) -> Column:
    """Marked hunk document; a side without lines has no marker."""
    side = lambda mark, x: F.when(F.size(x) > 0, F.concat(F.lit(mark), F.array_join(x, " "))).otherwise("")
    return F.concat(F.lit("[<HUNK>]"), side("[<DEL>]", source), side("[<ADD>]", target), F.lit("[</HUNK>]"))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return F.when(F.length(part) > 0, (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).otherwise(0)


def replace_once(text: Column, pairs: Column) -> Column:
    """Ordered fold: each (old, new) pair is applied only if its old text occurs exactly once."""
    return F.aggregate(pairs, text, lambda acc, p: F.when(occurrences(acc, p["old"]) == 1, F.replace(acc, p["old"], p["new"])).otherwise(acc))


def splice_lines(lines: Column, drop: Column, at: Column, patch: Column) -> Column:
    """Lines without the 0-based numbers in ``drop``, with ``patch`` put before position ``at``."""
    left = F.filter(lines, lambda x, i: (i < at) & ~F.array_contains(drop, i))
    right = F.filter(lines, lambda x, i: (i >= at) & ~F.array_contains(drop, i))
    return F.concat(left, patch, right)


def pad(values: Column, size: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(size - F.size(values), F.lit(0))))


def is_number(x: Column) -> Column:
    return strip(x).try_cast("double").isNotNull()


def normal_version(x: Column) -> Column:
    """``1.8`` → 8, ``11`` → 11; null if it is no number."""
    return F.floor(F.replace(x, F.lit("1."), F.lit("")).try_cast("double")).cast("int")


def with_body(text: Column, start: Column, end: Column, body: Column) -> Column:
    """``text`` with its lines start..end (from 1) exchanged for ``body``."""
    lines = F.split(text, "\n")
    left, right = F.filter(lines, lambda x, i: i + 1 < start), F.filter(lines, lambda x, i: i + 1 > end)
    return F.array_join(F.concat(left, F.array(body), right), "\n")


def count_lines(text: Column) -> Column:
    """Lines of a text file: a last line without an end counts, an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return ends + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def line_of_position(text: Column, position: Column) -> Column:
    """The line (from 1) that holds a character position (from 0)."""
    before = F.substring(text, F.lit(1), position)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def repository_path(url: Column) -> Column:
    """``owner/name`` of a repository's address."""
    return F.regexp_replace(F.regexp_extract(url, r"([^/:]+/[^/]+?)(?:\.git)?/?$", 1), r"\.git$", "")


def without_special(text: Column, marks: tuple[str, ...]) -> Column:
    """The text without any of the marks."""
    for mark in sorted(marks, key=len, reverse=True):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return strip(text)


def printed_alike(a: Column, b: Column) -> Column:
    """Whether two sources are the same but for white space."""
    plain = lambda x: F.regexp_replace(x, r"\s+", "")
    return plain(a).eqNullSafe(plain(b))


def counted(words: Column) -> Column:
    """Each distinct word with its count: array of ``w``, ``n`` (long), in the order of words. One sort, no shuffle."""
    start = lambda xs, i: (i == 1) | (F.get(xs, i - 1) != F.get(xs, i - 2))
    places = lambda xs: F.filter(F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs))).otherwise(F.array().cast("array<int>")), lambda i: start(xs, i))
    runs = lambda xs, at: F.transform(at, lambda i, j: F.struct(F.get(xs, i - 1).alias("w"), (F.coalesce(F.get(at, j + 1), F.size(xs) + 1) - i).cast("long").alias("n")))
    sided = F.transform(F.array(F.array_sort(words)), lambda xs: F.struct(xs.alias("xs"), places(xs).alias("at")))
    return F.get(F.transform(sided, lambda v: runs(v["xs"], v["at"])), F.lit(0))
