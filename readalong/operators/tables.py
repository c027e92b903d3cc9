"""Markdown tables to sentences, inside each row: runs of table lines are cut out of the array of lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readalong.functions.text import let, lines, sentence_end, strip, unix_lines

#: A line of a table.  Fixed value.
TABLE_LINE = r"(?Ud)^\s*\|.*\|\s*$"


def cells(line: Column) -> Column:
    """Trimmed cells of a table line; all pipes at its ends go, so outer empty cells vanish; none for a blank line."""
    body = strip(F.regexp_replace(strip(line), r"^\|+|\|+\z", ""))
    return let(body, lambda b: F.when(b == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(b, r"\|"), strip)))


def is_delimiter(row: Column) -> Column:
    """A row of nothing but alignment marks."""
    return (F.size(row) > 0) & F.forall(row, lambda c: c.rlike(r"^:?-{3,}:?\z"))


def _spoken_row(row: Column, headers: Column) -> Column:
    """One sentence of a data row, null for a row without any; empty cells go before headers are matched."""

    def said(own: Column) -> Column:
        n = F.least(F.size(headers), F.size(own))
        pairs = F.zip_with(F.slice(headers, F.lit(1), n), F.slice(own, F.lit(1), n), lambda h, v: F.when((h != "") & (v != ""), F.concat(h, F.lit(": "), v)))
        paired = let(F.filter(pairs, lambda p: p.isNotNull()), lambda p: F.when(F.size(p) > 0, F.array_join(p, "; ")).otherwise(F.array_join(own, ", ")))
        return F.when(F.size(own) > 0, sentence_end(paired))

    return let(F.filter(row, lambda c: c != ""), said)


def spoken(block: Column) -> Column:
    """The lines said for a run of table lines; the run itself if it has fewer than two rows of data or header."""

    def of_rows(rows: Column) -> Column:
        marks = F.transform(rows, is_delimiter)

        def of_data(data: Column) -> Column:
            has_header = (F.array_position(marks, True) == 2) & (F.size(F.get(data, F.lit(0))) >= 2)
            headers = F.when(has_header, F.get(data, F.lit(0))).otherwise(F.array().cast("array<string>"))
            rest = F.when(has_header, F.slice(data, F.lit(2), F.greatest(F.size(data) - 1, F.lit(0)))).otherwise(data)
            out = let(headers, lambda h: F.filter(F.transform(rest, lambda r: _spoken_row(r, h)), lambda s: s.isNotNull()))
            return F.when((F.size(rows) < 2) | (F.size(data) < 2), block).otherwise(F.concat(F.array(F.lit("Table:")), out, F.array(F.lit(""))))

        return let(F.filter(rows, lambda r: ~is_delimiter(r)), of_data)

    return let(F.filter(F.transform(block, cells), lambda r: F.size(r) > 0), of_rows)


def speak_tables(text: Column) -> Column:
    """Every run of table lines as sentences, other lines as they are."""

    def of_lines(all_lines: Column) -> Column:
        flags = F.transform(all_lines, lambda x: x.rlike(TABLE_LINE))

        def of_flags(f: Column) -> Column:
            # starts of runs of equal flags, then each run's slice
            starts = F.filter(F.transform(f, lambda x, i: F.when((i == 0) | (x != F.get(f, i - 1)), i)), lambda i: i.isNotNull())

            def of_starts(s: Column) -> Column:
                def run(start: Column, k: Column) -> Column:
                    end = F.coalesce(F.get(s, k + 1), F.size(all_lines))
                    part = F.slice(all_lines, start + 1, end - start)
                    return F.when(F.get(f, start), let(part, spoken)).otherwise(part)

                return F.array_join(F.flatten(F.transform(s, run)), "\n")

            return let(starts, of_starts)

        return let(flags, of_flags)

    # most texts hold no table line at all; they only lose their last line end
    return let(text, lambda t: F.when(t.contains("|"), let(lines(t), of_lines)).otherwise(unix_lines(t)))
