"""Tables of runs: written, read back, summarised and formatted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

HIERARCHY_METRICS = ["PDS", "cluster", "hierarchy", "levels", "n_vertices", "next_neighborhood", "next_positions", "sampling", "triangle_finding", "triangle_selection"]
SOLVER_METRICS = ["coarsest_solve", "cycles", "iterations", "reduction", "residue", "solver_total"]


def wide(timing: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """experiment and a column for each metric, in the metrics' order."""
    names = metrics or [r.metric for r in timing.select("metric").distinct().orderBy("metric").collect()]
    return timing.groupBy("experiment").pivot("metric", names).agg(F.first("value"))


def write_timing(timing: DataFrame, path: str, fresh: bool, metrics: list[str] | None = None) -> None:
    """With fresh a new table, whose metrics are those given or found; else rows added to it, in its columns."""
    if not fresh:
        have = timing.sparkSession.read.option("header", True).csv(path).columns[1:]
        others = timing.where(~F.col("metric").isin(have)).select("metric").limit(1).collect()
        if others:
            raise ValueError(f"the table has no column {others[0].metric}")
        metrics = have
    wide(timing, metrics).coalesce(1).write.mode("overwrite" if fresh else "append").option("header", True).csv(path)


def write_convergence(history: DataFrame, path: str) -> None:
    history.orderBy("iter").select(F.col("ms").alias("time"), "residue").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_sparse(a: DataFrame, path: str) -> None:
    a.select("i", "j", "v").orderBy("i", "j").write.mode("overwrite").option("sep", "\t").csv(path)


def write_dense(x: DataFrame, path: str, columns: int) -> None:
    """A row for each i with its columns, tab-separated."""
    x.groupBy("i").pivot("col", list(range(columns))).agg(F.first("v")).orderBy("i").drop("i").write.mode("overwrite").option("sep", "\t").csv(path)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """A line `name: value` for each."""
    rows = [(f"{k}: {v}",) for k, v in settings.items()]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def read_timing(spark: SparkSession, path: str, metrics: list[str], seconds: tuple[str, ...] = ()) -> DataFrame:
    """experiment and the metrics' columns, by their names in the header; those in seconds become milliseconds."""
    t = spark.read.option("header", True).csv(path)
    value = lambda m: F.col(f"`{m}`").cast("double") * (1000.0 if m in seconds else 1.0)
    return t.select("experiment", *[value(m).alias(m) for m in metrics])


#: Columns of the report: those of a method's runs, with its prefix.
GROUP = ("hierarchy", "iterations", "solver", "residue")


def combined(shapes: DataFrame, ours: DataFrame, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """A row for each shape, by its number of vertices: shapes (experiment, n_vertices), the mean and deviation of our
    runs (experiment and GROUP's columns, a row for each run), and the columns of the other methods (experiment and some of
    GROUP's) with their names before them. A shape without a method's run has nulls there."""
    means = [f(c).alias(f"our_{c}{end}") for c in GROUP if c in ours.columns for f, end in ((F.avg, ""), (F.stddev_samp, "_std"))]
    out = shapes.select("experiment", "n_vertices").join(ours.groupBy("experiment").agg(*means), "experiment", "left")
    for name, runs in (others or {}).items():
        out = out.join(runs.select("experiment", *[F.col(c).alias(f"{name}_{c}") for c in GROUP if c in runs.columns]), "experiment", "left")
    return out.orderBy("n_vertices", "experiment")


def with_deviation(mean: Column, deviation: Column, places: int = 2) -> Column:
    """`mean(deviation)` with two places."""
    return F.concat(text.fixed(mean, places), F.lit("("), text.fixed(deviation, places), F.lit(")"))


def summary(runs: DataFrame, group: str, value: str) -> DataFrame:
    """For each group the maximum, mean, sample deviation and median."""
    return runs.groupBy(group).agg(F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, F.lit(0.5)).alias("median"))


def beside(left: DataFrame, right: DataFrame, key: str, by_position: bool = False) -> DataFrame:
    """Columns of both, by equal keys; by_position pairs rows of the same rank among the keys."""
    if not by_position:
        return left.join(right, key)
    rank = lambda t: t.withColumn("rank_", F.row_number().over(Window.orderBy(key)))
    return rank(left).join(rank(right).drop(key), "rank_").drop("rank_")


def renamed(table: DataFrame, names: dict[str, str]) -> DataFrame:
    return table.withColumnsRenamed(names)


def formatted(table: DataFrame, name: str, count: str, times: list[str]) -> DataFrame:
    """Names as titles, counts in thousands, milliseconds as seconds with two places."""
    return table.select(text.title(F.col(name)).alias(name), text.thousands(F.col(count)).alias(count), *[text.fixed(F.col(c) / 1000).alias(c) for c in times])


def latex_rows(table: DataFrame) -> DataFrame:
    """value: a booktabs row for each row of strings."""
    return table.select(F.concat(F.array_join(F.array(*[F.col(c).cast("string") for c in table.columns]), " & "), F.lit(" \\\\")).alias("value"))


def write_latex(table: DataFrame, path: str) -> None:
    """One text file: head, rows in the table's order, foot. Report tables are a row for each shape."""
    spark = table.sparkSession
    rows = [r.value for r in latex_rows(table).collect()]
    lines = [f"\\begin{{tabular}}{{{'l' * len(table.columns)}}}", "\\toprule", " & ".join(table.columns) + " \\\\", "\\midrule", *rows, "\\bottomrule", "\\end{tabular}"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
