"""Where results go: partitioned tables, artifacts and reports, through Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(rows: DataFrame, folder: str, *by: str, mode: str = "overwrite") -> None:
    """A table in folders of ``by``; with ``overwrite``, only folders that ``rows`` has are replaced."""
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def write_artifacts(rows: DataFrame, folder: str) -> None:
    """One JSON document a row."""
    rows.write.mode("overwrite").json(folder)


def _shown(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.4f", value.cast("double")))


def report(metrics: DataFrame, title: str, sections: dict[str, list[str]]) -> DataFrame:
    """value: each row of ``metrics`` as Markdown, a section for each name with its columns; arrays are lists, numbers have four places."""
    types = dict(metrics.dtypes)
    lines = [F.lit(f"# {title}\n")]
    for name, columns in sections.items():
        lines.append(F.lit(f"\n## {name}\n\n"))
        for c in columns:
            if types[c].startswith("array"):
                lines.append(F.array_join(F.transform(F.coalesce(c, F.array().cast(types[c])), lambda x: F.concat(F.lit("- "), x.cast("string"), F.lit("\n"))), ""))
            else:
                shown = F.coalesce(F.col(c).cast("string"), F.lit("n/a")) if types[c] in ("boolean", "string") else _shown(F.col(c))
                lines.append(F.concat(F.lit(f"- {c}: "), shown, F.lit("\n")))
    return metrics.select(F.concat(*lines).alias("value"))


def write_report(metrics: DataFrame, folder: str, title: str, sections: dict[str, list[str]]) -> None:
    """The metrics as JSON and as Markdown, beside each other; ``metrics`` is one row or a few."""
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    report(metrics, title, sections).coalesce(1).write.mode("overwrite").text(f"{folder}/markdown")
