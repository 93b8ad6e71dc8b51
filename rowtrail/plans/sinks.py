"""Where results go: tables a cell, JSON and Markdown reports, cached series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "dataset string, model string, n_train long, seed long, fit_seconds double, metrics map<string,double>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a results file (an object with a list ``results``); a file that isn't there is an error."""
    raw = spark.read.option("multiLine", True).schema(f"results array<struct<{', '.join(c.replace(' ', ':', 1) for c in SCHEMA.split(', '))}>>").json(path)
    return raw.select(F.explode("results").alias("r")).select("r.*")


def unavailable(spark: SparkSession, path: str) -> dict[str, str]:
    """What a results file says could not be run, and why."""
    row = spark.read.option("multiLine", True).schema("unavailable map<string,string>").json(path).first()
    return dict(row.unavailable or {}) if row else {}


def write_results(results: DataFrame, path: str, missing: dict[str, str] | None = None) -> None:
    """One JSON object with all rows, sorted; results tables are small, a row a cell."""
    names = ("dataset", "n_train", "seed", "model")
    one = results.orderBy(*names).coalesce(1).agg(F.collect_list(F.struct(*names, "fit_seconds", "metrics")).alias("results"))
    kept = F.create_map(*[F.lit(x) for kv in (missing or {}).items() for x in kv]) if missing else F.create_map().cast("map<string,string>")
    text = F.to_json(F.struct("results", kept.alias("unavailable")))
    one.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_cell(cell: dict, spark: SparkSession, path: str) -> None:
    """Add one result row to a table, so that a run that stops goes on where it was."""
    row = (cell["dataset"], cell["model"], int(cell["n_train"]), int(cell["seed"]), float(cell["fit_seconds"]), {k: float(v) for k, v in cell["metrics"].items()})
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def done_cells(spark: SparkSession, path: str) -> set[tuple]:
    """(dataset, model, n_train, seed) of the rows that are there; none where there is no table yet."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
        return {tuple(r) for r in rows.select("dataset", "model", "n_train", "seed").collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return set()
        raise


def markdown(table: DataFrame, places: int = 3) -> str:
    """A small table as Markdown lines, numbers with so many places, NULL as a dash."""
    cell = lambda v: "—" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    lines = [f"| {' | '.join(table.columns)} |", "|---" * len(table.columns) + "|"]
    return "\n".join([*lines, *(f"| {' | '.join(map(cell, r))} |" for r in table.collect())])


def write_report(spark: SparkSession, title: str, parts: dict[str, DataFrame], path: str) -> str:
    """A report of tables under headings, as one text file; returns the text."""
    text = "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown(t)}" for name, t in parts.items())])
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def cached(rows: DataFrame, path: str) -> DataFrame:
    """Rows written at ``path`` once and read from there ever after."""
    rows.write.mode("ignore").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)

