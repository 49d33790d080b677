"""Reports as lines of text: a heading, its facts, a table row for each record, written as files that read in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STYLES = ("html", "markdown")


def escaped(text: Column, style: str = "html") -> Column:
    """A cell's text in one line, its markup made harmless; null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for plain, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    if style == "markdown":
        text = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(text, r"\r\n|\r|\n", "<br>")


def lines(rows: DataFrame, group: str, order: str, cells: dict[str, Column], facts: DataFrame, style: str = "html") -> DataFrame:
    """group, section, place and line: the report of each group, in the order of section and place.

    ``facts`` has one row a group with its text in ``facts``; a group without facts has a report without them. Records
    are lines of their own, so a group of any size is never one value.
    """
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}")
    html = style == "html"
    row = lambda texts: F.concat(*_between(texts, *("<tr><td>", "</td><td>", "</td></tr>") if html else ("| ", " | ", " |")))
    body = rows.select(group, F.lit(4).alias("section"), F.col(order).alias("place"), row([escaped(c, style) for c in cells.values()]).alias("line"))
    names = [F.lit(n) for n in cells]
    groups = rows.select(group).distinct().join(facts.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")), "left")
    title, fact = escaped(F.col(group), style), escaped(F.col("facts"), style)
    if html:
        frame = [(1, F.concat(F.lit("<h1>"), title, F.lit("</h1>"))), (2, F.concat(F.lit("<p>"), fact, F.lit("</p>"))), (3, F.concat(F.lit("<table>"), row(names))), (5, F.lit("</table>"))]
    else:
        frame = [(1, F.concat(F.lit("# "), title)), (2, fact), (3, row(names)), (3, row([F.lit("---")] * len(cells)))]
    around = groups.select(group, F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(i).alias("i"), text.alias("line")) for i, (s, text) in enumerate(frame)])).alias("f"))
    place = F.col("f.i").cast(rows.schema[order].dataType)
    return around.select(group, "f.section", place.alias("place"), "f.line").unionByName(body)


def _between(texts: list[Column], left: str, middle: str, right: str) -> list[Column]:
    out = [F.lit(left)]
    for text in texts:
        out += [text, F.lit(middle)]
    return [*out[:-1], F.lit(right)]


def save(report: DataFrame, path: str, group: str) -> None:
    """Text files in a folder a group; by name, then by line, they read as the report."""
    ordered = report.repartitionByRange(group, "section", "place").sortWithinPartitions(group, "section", "place")
    ordered.select(group, F.col("line").alias("value")).write.partitionBy(group).text(path)
