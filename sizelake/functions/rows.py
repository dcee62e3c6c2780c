"""Labels of table rows as Columns, on top of the cells' number test; no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sizelake.functions.numbers import is_number_cell

MOST_PARTS, MOST_HEADER_ROWS = 3, 3


def _cell(row: Column, c) -> Column:
    return F.trim(F.coalesce(F.get(row, c), F.lit("")))


def header_count(rows: Column) -> Column:
    """How many leading rows are headers: those before the first row with a number, three at most, one at least, never all."""
    numeric = F.transform(F.slice(rows, 1, MOST_HEADER_ROWS), lambda r: F.exists(r, is_number_cell))
    first = F.array_position(numeric, F.lit(True))
    lead = F.when(first > 0, first - 1).otherwise(F.least(F.lit(MOST_HEADER_ROWS), F.size(rows)))
    return F.greatest(F.lit(1), F.least(lead, F.size(rows) - 1)).cast("int")


def width_of(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def _named(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.array_join(p, " / "))


def row_labels(rows: Column) -> Column:
    """A label for each data row: the texts of its columns from the left, columns of numbers left out, as many as it takes to
    tell all rows apart, three parts at most. Where no column has a text, the first cells. Null for no table."""
    data = F.slice(rows, header_count(rows) + 1, F.size(rows))
    width = width_of(data)
    start = F.transform(data, lambda r: F.array().cast("array<string>"))

    def add(parts, c):
        column = F.transform(data, lambda r: _cell(r, c))
        filled = F.filter(column, lambda x: x != "")
        numbers = (F.size(filled) > 0) & F.forall(filled, is_number_cell)
        names = _named(parts)
        apart = F.forall(names, lambda x: x != "") & (F.size(F.array_distinct(names)) == F.size(names))
        full = F.coalesce(F.array_max(F.transform(parts, F.size)), F.lit(0)) >= MOST_PARTS
        longer = F.zip_with(parts, column, lambda p, x: F.when((x == "") | F.array_contains(p, x), p).otherwise(F.concat(p, F.array(x))))
        return F.when(numbers | apart | full, parts).otherwise(longer)

    columns = F.when(width > 0, F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    labels = _named(F.aggregate(columns, start, add))
    blank = F.forall(labels, lambda x: x == "")
    return F.when(F.size(rows) > 0, F.when(blank, F.transform(data, lambda r: _cell(r, F.lit(0)))).otherwise(labels))


def column_headers(rows: Column, longest: int = 80) -> Column:
    """A header for each column: the texts of the header rows from the top, repeats said once, joined. Upper rows are left out
    for the whole table, as few as it takes for every header to keep within `longest`; the last row always stays."""
    n, width = header_count(rows), width_of(rows)
    columns = F.when(width > 0, F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def without(k):
        head = F.slice(rows, k + 1, F.greatest(n - k, F.lit(0)))
        return F.transform(columns, lambda c: F.array_join(F.array_distinct(F.filter(F.transform(head, lambda r: _cell(r, c)), lambda x: x != "")), " / "))

    fits = lambda h: F.forall(h, lambda x: F.length(x) <= longest)
    tries = [F.when((n > k) & fits(without(F.lit(k))), without(F.lit(k))) for k in range(MOST_HEADER_ROWS)]
    return F.when(F.size(rows) > 0, F.transform(F.coalesce(*tries, without(n - 1)), lambda x: F.trim(F.substring(x, 1, longest))))
