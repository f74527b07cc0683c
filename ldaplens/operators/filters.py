"""Stacked filters (F1-F15) compiled to one Spark predicate.

A ``Filter`` tests one parsed field for string equality (absent -> false), or
the normalised text for a literal substring, optionally AND-ed with an
inclusive line range. A ``FilterStack`` is an immutable conjunction; ``push``,
``pop`` and ``clear`` return new stacks. ``apply_filters`` puts the cheap
substring pre-test on the *unparsed* line first, so lines that cannot match
never reach the regex extraction.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Filter kinds, their key text, the parsed column each compares,
# and how a filter prints ("text" prints as text:<v>, the others as key=<v>).
FILTER_KINDS = ("conn", "dn", "op", "base", "err", "thread", "text")
FILTER_COLUMNS = {
    "conn": "conn_id",
    "dn": "dn",
    "op": "op_id",
    "base": "base",
    "err": "error_code",
    "thread": "thread_id",
}
NUMERIC_KINDS = ("conn", "op", "err")
LABEL_SEPARATOR = " > "


def between_lines(line_no: str, start: int | None, end: int | None) -> Column:
    """``start <= line_no <= end``, either end open."""
    p = F.lit(True)
    if start is not None:
        p = p & (F.col(line_no) >= start)
    if end is not None:
        p = p & (F.col(line_no) <= end)
    return p


@dataclass(frozen=True)
class Filter:
    kind: str
    value: str
    range_start: int | None = None
    range_end: int | None = None
    key: str | None = None

    def __post_init__(self):
        if self.kind not in FILTER_KINDS:
            raise ValueError(f"unknown filter kind {self.kind!r}")
        if self.key is None:
            object.__setattr__(self, "key", "" if self.kind == "text" else self.kind)

    @property
    def has_range(self) -> bool:
        return self.range_start is not None or self.range_end is not None

    def with_range(self, start: int | None, end: int | None) -> "Filter":
        return replace(self, range_start=start, range_end=end)

    def value_predicate(self) -> Column:
        """F1-F7 on parsed columns; ``coalesce`` turns an absent field into false."""
        if self.kind == "text":
            return F.col("raw").contains(F.lit(self.value))
        return F.coalesce(F.col(FILTER_COLUMNS[self.kind]) == F.lit(self.value), F.lit(False))

    def predicate(self, line_no: str = "line_no") -> Column:
        """F8: the value test AND-ed with the inclusive line range; an open end does not limit."""
        return self.value_predicate() & between_lines(line_no, self.range_start, self.range_end)

    def candidate(self, value: str = "value") -> Column:
        """a necessary condition on the unparsed line (never rejects a match).

        Normalisation may change blanks between words, so only the value's part
        before its first blank is looked for. The value of a numeric field must
        not go on with a digit: ``conn=8`` is not found in ``conn=80``.
        """
        v = F.col(value)
        if self.kind == "text":
            return F.lit(True)
        word = re.split(r"\s", self.value, maxsplit=1)[0]
        if self.kind == "thread":
            return v.contains(F.lit(word))
        if self.kind in NUMERIC_KINDS:
            if not re.fullmatch("[0-9]+", self.value):
                return F.lit(False)  # such a field holds digits only
            return v.contains(F.lit(f"{self.key}={word}")) & v.rlike(f"{re.escape(self.key)}={word}(?![0-9])")
        return v.contains(F.lit(f'{self.key}="{word}'))

    def label(self) -> str:
        """F13."""
        if self.kind == "text":
            return f"text:{self.value}"
        return f"{self.kind}={self.value}"


@dataclass(frozen=True)
class FilterStack:
    filters: tuple = field(default_factory=tuple)

    # immutable push / pop / clear
    def push(self, f: Filter) -> "FilterStack":
        return FilterStack(self.filters + (f,))

    def pop(self) -> "FilterStack":
        return FilterStack(self.filters[:-1]) if self.filters else self

    def clear(self) -> "FilterStack":
        return FilterStack(())

    def __len__(self) -> int:
        return len(self.filters)

    @property
    def empty(self) -> bool:
        return not self.filters

    # conjunction; empty matches everything
    def predicate(self, line_no: str = "line_no") -> Column:
        if not self.filters:
            return F.lit(True)
        return functools.reduce(lambda a, b: a & b, (f.predicate(line_no) for f in self.filters))

    def candidate(self, value: str = "value") -> Column:
        if not self.filters:
            return F.lit(True)
        return functools.reduce(lambda a, b: a & b, (f.candidate(value) for f in self.filters))

    # intersection of the ranges carried by the stack
    @property
    def has_range(self) -> bool:
        return any(f.has_range for f in self.filters)

    def range_start(self) -> int:
        return max([f.range_start for f in self.filters if f.range_start is not None], default=0)

    def range_end(self) -> int | None:
        """Smallest range end; None means unbounded."""
        ends = [f.range_end for f in self.filters if f.range_end is not None]
        return min(ends) if ends else None

    def range_predicate(self, line_no: str = "line_no") -> Column:
        if not self.has_range:
            return F.lit(True)
        return between_lines(line_no, self.range_start(), self.range_end())

    # F13
    def label(self) -> str:
        return LABEL_SEPARATOR.join(f.label() for f in self.filters)


def apply_filters(df: DataFrame, stack: FilterStack, parse=None) -> DataFrame:
    """the lines passing the stack, in their natural ``(file, line_no)`` order.

    ``df`` is either parsed rows or raw ``(file, line_no, value)`` lines with
    ``parse`` (a DataFrame -> DataFrame function such as ``parse_logs``). The
    range intersection and the substring candidate test run before parsing,
    so they reach the Parquet scan as pushed filters and skip the regexes.
    """
    if stack.empty:
        return df if parse is None else parse(df)
    pre = stack.range_predicate() & stack.candidate()
    narrowed = df.where(pre)
    if parse is not None:
        narrowed = parse(narrowed)
    else:  # bare equalities reach the scan, where a row group's dictionary or Bloom filter may rule it out
        for f in stack.filters:
            if f.kind != "text":
                narrowed = narrowed.where(F.col(FILTER_COLUMNS[f.kind]) == F.lit(f.value))
    return narrowed.where(stack.predicate())


def filter_label_col(stack: FilterStack) -> Column:
    """F13 as a column, for unioning results of several stacks."""
    return F.lit(stack.label()).alias("filter_label")


def apply_filters_stream(df: DataFrame, stack: FilterStack, parse=None) -> DataFrame:
    """the stack on a stream of new lines. Line ranges are dropped: a range
    captured earlier would wrongly exclude later lines of the same connection."""
    no_range = FilterStack(tuple(replace(f, range_start=None, range_end=None) for f in stack.filters))
    return apply_filters(df, no_range, parse)
