"""Markdown of small frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_row(*cells: Column | str) -> Column:
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |"))


def markdown_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line): header, divider and a line for each row, in the given order, of a small frame."""
    from pyspark.sql import Window

    top = df.sparkSession.createDataFrame([(1, list(df.columns)), (2, ["---"] * len(df.columns))], "line_no int, cells array<string>")
    number = (F.row_number().over(Window.orderBy(*order)) + 2).cast("int")
    body = df.select(number.alias("line_no"), markdown_row(*df.columns).alias("line"))
    return top.select("line_no", markdown_row(*(F.col("cells")[k] for k in range(len(df.columns)))).alias("line")).unionByName(body)


def report_lines(title: str, parts: list[tuple[str, DataFrame, list[str]]]) -> DataFrame:
    """(line_no, line) of a report: a title, and under a heading each of the small frames as a table, in the given order."""
    from pyspark.sql import Window

    spark = parts[0][1].sparkSession

    def lines(part: int, *texts: str) -> DataFrame:
        return spark.createDataFrame([(part, k, x) for k, x in enumerate(texts)], "part int, line_no int, line string")

    out = [lines(0, f"# {title}", "")]
    for k, (heading, df, order) in enumerate(parts):
        out += [lines(3 * k + 1, f"## {heading}", ""), markdown_lines(df, order).select(F.lit(3 * k + 2).alias("part"), "line_no", "line"), lines(3 * k + 3, "")]
    place = F.row_number().over(Window.orderBy("part", "line_no"))
    return reduce(DataFrame.unionByName, out).select(place.cast("int").alias("line_no"), "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write (line_no, line) as one text file in a folder."""
    lines.orderBy("line_no").coalesce(1).select("line").write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """Write a small frame as a markdown file in a folder."""
    write_lines(markdown_lines(df, order), path)
