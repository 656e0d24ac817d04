"""Writing tables, reports and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns, null as empty; Spark's committer shows all files or none."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_by_role(df: DataFrame, path: str, role: str = "split_role") -> None:
    df.write.mode("overwrite").partitionBy(role).parquet(path)


def write_splits(df: DataFrame, path: str, columns: list[str], roles: list[str], role: str = "split_role") -> None:
    """``path/role=<role>``: CSV files with a header for every role, of which an empty one has
    nothing but its header. All roles are written by one pass."""
    rows = df.where(F.col(role).isin(*roles)).select(*columns, F.col(role).alias("role"))
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").partitionBy("role").csv(path)
    found = {r[0] for r in df.select(role).distinct().collect()}  # roles are few
    for name in roles:
        if name not in found:
            write_csv(df.limit(0), f"{path}/role={name}", columns)


def write_outputs(df: DataFrame, path: str, columns: list[str], roles: list[str], statistics: DataFrame, report: str, role: str = "split_role") -> None:
    """What a split run leaves: splits, statistics (JSON lines) and a report."""
    write_splits(df, f"{path}/splits", columns, roles, role)
    write_json(statistics.coalesce(1), f"{path}/statistics")
    df.sparkSession.createDataFrame([(report.removesuffix("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def failures(metadata: DataFrame) -> DataFrame:
    return metadata.where("status <> 'success' or status is null")


def markdown_row(name: str = "metric", value: str = "value"):
    return F.concat(F.lit("| "), F.col(name), F.lit(" | "), F.when(F.col(value).isNull(), "n/a").otherwise(F.format_string("%.4f", F.col(value).cast("double"))), F.lit(" |"))


def markdown_table(metrics: DataFrame) -> str:
    """A report of few rows (metric, value): formatted on the driver."""
    rows = [r[0] for r in metrics.orderBy("metric").select(markdown_row()).collect()]
    return "\n".join(["| metric | value |", "|---|---|", *rows])


def text_report(title: str, row: DataFrame) -> str:
    """A one-row result as lines of text."""
    r = row.first()
    return "\n".join([title, "=" * len(title), *(f"{k}: {v}" for k, v in r.asDict().items())])


def _cell(value: object) -> str:
    return "n/a" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def table_of(df: DataFrame, columns: list[str], order: list[str]) -> list[str]:
    """The lines of a Markdown table of a small result."""
    rows = df.orderBy(*order).select(*columns).collect()
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(map(_cell, r)) + " |" for r in rows)]


def gap_report(metrics: DataFrame, gaps: DataFrame, names: list[str], title: str = "Generalization gap") -> str:
    """Metrics per model and split, confusion counts, and seen minus unseen per model, or why there
    is none."""
    lines = [f"# {title}", "", "## Metrics", "", *table_of(metrics, ["model", "split", *names, "support", "tn", "fp", "fn", "tp"], ["model", "split"]), "", "## Gap (seen - unseen)", ""]
    return "\n".join([*lines, *table_of(gaps, ["model", *(f"{n}_gap" for n in names), "note"], ["model"]), ""])


def calibration_report(rows: DataFrame, keys: list[str], temperature: float, title: str = "Calibration") -> str:
    """Metrics before and after a temperature, and what it changed, for each key."""
    names = ["ece", "brier", "nll", "f1"]
    at = lambda c, s: F.max(F.when(F.col("stage") == s, F.col(c)))
    change = rows.groupBy(*keys).agg(*((at(n, "after") - at(n, "before")).alias(n) for n in names))
    lines = [f"# {title}", "", f"Temperature: {temperature:.4f}", "", *table_of(rows, [*keys, "stage", *names], [*keys, "stage"]), "", "## Change", ""]
    return "\n".join([*lines, *table_of(change, [*keys, *names], keys), ""])
