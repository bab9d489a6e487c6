"""Text expressions: paths, lines, patterns.  All are built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every line break a text file may hold, besides the newline itself.
OTHER_LINE_BREAKS = ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]


def regex(pattern: str) -> str:
    """A pattern with `.` stopping only at a newline and Unicode-aware classes and case folding."""
    return "(?dU)" + pattern


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def holds(value: Column, test: Callable[[Column], Column]) -> Column:
    """Whether `test(value)` is true, with `value` computed once however often the test names it."""
    return F.exists(F.array(value), test)


def given(value: Column, result: Callable[[Column], Column]) -> Column:
    """`result(value)` with `value` computed once however often the result names it."""
    return F.element_at(F.transform(F.array(value), result), 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last `.ext` of the file name; a leading dot alone does not start a suffix."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def newline_breaks(content: Column) -> Column:
    """The content with every kind of line break as one newline.

    Plain replacements: each returns the text as it is where nothing is to be
    replaced, which a pattern does not.
    """
    for mark in OTHER_LINE_BREAKS:
        content = F.replace(content, F.lit(mark), F.lit("\n"))
    return content


def lines(content: Column) -> Column:
    return F.split(newline_breaks(content), "\n")


def line_in(broken: Column, needle: Column) -> Column:
    """Number of the first line that contains `needle`, 1 if none does; `broken` comes from `newline_breaks`.

    Counts the newlines before the first occurrence, so no line array is built.
    A needle that itself spans lines is in no single line, hence 1.
    """
    def number(before: Column) -> Column:
        newlines = F.octet_length(before) - F.octet_length(F.replace(before, F.lit("\n"), F.lit("")))
        found = F.octet_length(before) < F.octet_length(broken)
        return F.when(found & ~F.contains(needle, F.lit("\n")), newlines + 1).otherwise(1).cast("bigint")

    return given(F.call_function("substring_index", broken, needle, F.lit(1)), number)


def line_of(content: Column, needle: Column) -> Column:
    """As `line_in`, for content as it is."""
    return line_in(newline_breaks(content), needle)


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def fill(template: str, **values: Column | str) -> Column:
    """`template` with each `{name}` replaced by a value; other braces stay as they are."""
    pieces: list[Column] = []
    rest = template
    while True:
        found = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not found:
            break
        at, name = min(found)
        if at:
            pieces.append(F.lit(rest[:at]))
        value = values[name]
        pieces.append(F.lit(value) if isinstance(value, str) else value)
        rest = rest[at + len(name) + 2:]
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)
