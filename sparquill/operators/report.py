"""Reports of metrics as numbered lines of Markdown or HTML, a section for each evaluator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(results: DataFrame, how: str) -> DataFrame:
    """(evaluator, place, line) of results (evaluator, metric, value); how: "markdown" or "html". An evaluator's metrics, a few by definition, stand in order of their names."""
    sections = results.groupBy("evaluator").agg(F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("m"))
    e, number = F.col("evaluator"), lambda x: F.format_string("%.4f", x["value"])

    def fixed(*parts: str) -> Column:
        return F.array(*(F.concat(F.lit(p.split("{}")[0]), e, F.lit(p.split("{}")[1])) if "{}" in p else F.lit(p) for p in parts))

    if how == "markdown":
        body = F.concat(fixed("## {} Evaluation", "", "### Overall Scores", "", "| Metric | Score |", "|--------|-------|"), F.transform("m", lambda x: F.concat(F.lit("| "), x["metric"], F.lit(" | "), number(x), F.lit(" |"))), fixed("", "---", ""))
    else:
        row = lambda x: F.concat(F.lit("<tr><td>"), x["metric"], F.lit('</td><td class="score">'), number(x), F.lit("</td></tr>"))
        body = F.concat(fixed('<div class="evaluator">', "<h2>{} Evaluation</h2>", "<h3>Overall Scores</h3>", "<table>", "<tr><th>Metric</th><th>Score</th></tr>"), F.transform("m", row), fixed("</table>", "</div>"))
    return sections.select("evaluator", F.posexplode(body).alias("place", "line")).select("evaluator", F.col("place").cast("long").alias("place"), "line")
