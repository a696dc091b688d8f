"""Writers: Spark's own commit protocol is the atomic rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f4(value: Column) -> Column:
    """Four decimals; null is blank."""
    return F.when(value.isNull(), "").otherwise(F.format_string("%.4f", value))


def cell_columns(df: DataFrame) -> list[Column]:
    """All columns as text for a CSV without quoting: floats with four decimals, commas as semicolons."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        text = f4(c) if kind in ("double", "float") else F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string")
        out.append(F.coalesce(F.translate(text, ",\n", "; "), F.lit("")).alias(f.name))
    return out


def cell_text(df: DataFrame) -> DataFrame:
    """The rows of a table as ``cell_columns`` have them."""
    return df.select(*cell_columns(df))


def write_table(df: DataFrame, path: str, *order: Column | str) -> None:
    """A CSV table without quotes, sorted, in parts: put together in the order of their names they are one file with one header.

    The rows are cut into ranges of ``order`` and each range is sorted and
    written by a task of its own; the header is a row before all others. A
    last key of chance spreads rows that are equal in ``order`` (columns and
    expressions, rising). Without an
    order the rows stay as they are dealt, behind the header.
    """
    keys = {f"_k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    rows = df.select(F.concat_ws(",", *cell_columns(df)).alias("_line"), F.lit(1).alias("_after"), F.rand(0).alias("_tie"), *[c.alias(k) for k, c in keys.items()])
    head = df.sparkSession.range(1).select(F.lit(",".join(df.columns)).alias("_line"), F.lit(0).alias("_after"))
    both = head.unionByName(rows, allowMissingColumns=True)
    cut = both.repartitionByRange("_after", *keys, "_tie").sortWithinPartitions("_after", *keys, "_tie")
    cut.select("_line").write.text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_intervals(df: DataFrame, path: str) -> None:
    """Intervals with the observed values as a space-joined list."""
    write_table(df.withColumn("observed", F.array_join(F.transform("observed", lambda x: F.format_string("%.4f", x)), " ")), path)


def write_sheet(df: DataFrame, path: str) -> None:
    """A label sheet: quoted fields with doubled quotes, white space kept, a byte order mark in front of each file."""
    first, *rest = df.columns
    marked = df.withColumnRenamed(first, "\ufeff" + first)
    marked.write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def pct(value: Column, digits: int = 2) -> Column:
    """Some decimals; null is n/a."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", value))


def share_text(value: Column) -> Column:
    """A share as whole per cent; null is n/a."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.0f%%", value * 100))


def interval_text(point: Column, lo: Column, hi: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", point, lo, hi)


def markdown_rows(df: DataFrame) -> DataFrame:
    """The rows of a Markdown table as lines; all of them."""
    cells = cell_text(df)
    return cells.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(f"`{c}`") for c in cells.columns]), F.lit(" |")).alias("line"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table as Markdown; reports have a row per arm or cell. Beyond ``limit`` rows the last line says that there are more."""
    rows = [r.line for r in markdown_rows(df).take(limit + 1)]
    more = [f"(more than {limit} rows)"] if len(rows) > limit else []
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *rows[:limit], *more])


def pretty_json(df: DataFrame) -> DataFrame:
    """Each row as an indented JSON object with its keys in order; for numbers and ASCII text."""
    parts = [F.concat(F.lit(f'  "{c}": '), F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))) for c in sorted(df.columns)]
    parts = [F.when(F.col(c).isNull(), f'  "{c}": null').otherwise(p) for c, p in zip(sorted(df.columns), parts)]
    return df.select(F.concat(F.lit("{\n"), F.concat_ws(",\n", *parts), F.lit("\n}")).alias("json"))


def private_mirror(df: DataFrame, path: str, arm: str, cell: str) -> None:
    """Full rows in a folder of their own, by arm and cell."""
    df.write.partitionBy(arm, cell).json(path)


def table_lines(df: DataFrame, **widths: int) -> DataFrame:
    """The lines of a console table: text to the left, numbers to the right, in columns of the given widths."""
    kinds = dict(df.dtypes)
    cells = cell_text(df.select(*widths))
    side = lambda c, w: F.lpad(c, w, " ") if kinds[c] in ("int", "bigint", "double") else F.rpad(c, w, " ")
    return cells.select(F.concat_ws("  ", *[side(c, w) for c, w in widths.items()]).alias("line"))


def forbidden(df: DataFrame, column: str, terms: list[str]) -> DataFrame:
    """Rows whose text has one of the terms, case-insensitively, with the terms found."""
    low = F.lower(F.col(column))
    found = F.filter(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms]), lambda t: t.isNotNull())
    return df.withColumn("terms", found).where(F.size("terms") > 0)


def guarded_write(df: DataFrame, column: str, terms: list[str], path: str) -> None:
    """Write only if no row has a forbidden term."""
    if not forbidden(df, column, terms).isEmpty():
        raise ValueError("the output holds a term that must not be published")
    df.write.json(path)
