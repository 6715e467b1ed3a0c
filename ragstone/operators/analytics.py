"""Analytics over result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_runs(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def results_per_query(run: DataFrame) -> DataFrame:
    """n_results, n_queries: how many queries have how many results."""
    return run.groupBy("query_id").agg(F.count("*").alias("n_results")).groupBy("n_results").agg(F.count("*").alias("n_queries"))


def validate_counts(run: DataFrame, want: int = 10) -> DataFrame:
    """One row: queries, all_equal, violators."""
    n = run.groupBy("query_id").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("queries"), F.coalesce(F.min(F.col("n") == want), F.lit(True)).alias("all_equal"), F.count_if(F.col("n") != want).alias("violators"))


def null_audit(rows: DataFrame) -> DataFrame:
    """One row: nulls over all cells."""
    return rows.agg(reduce(Column.__add__, (F.count_if(F.col(c).isNull()) for c in rows.columns)).alias("nulls"))


def argmax(rows: DataFrame, metric: str, *by: str, tie: str) -> DataFrame:
    """The row of each group's greatest metric; the least tie column among equals."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc(), F.col(tie))
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def group_mean_std(rows: DataFrame, metric: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("count"))


def pivot_mean(rows: DataFrame, index: str, column: str, values: Sequence, metric: str) -> DataFrame:
    return rows.groupBy(index).pivot(column, list(values)).avg(metric)


def mean_by_pair(rows: DataFrame, index: str, column: str, metric: str) -> DataFrame:
    """The cells of pivot_mean() as rows, for columns with unknown or very many values."""
    return rows.groupBy(index, column).agg(F.avg(metric).alias("mean"))


def score_stats(run: DataFrame, *by: str) -> DataFrame:
    """Mean, least and greatest score of each group."""
    return run.groupBy(*by).agg(F.avg("score").alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


def choices(rows: DataFrame, column: str) -> DataFrame:
    """How often each value was chosen."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def smallest_then_best(rows: DataFrame, small: str, n: int, metric: str, tie: str) -> DataFrame:
    """Of the n rows least in one column, the one best in another."""
    return rows.orderBy(small, tie).limit(n).orderBy(F.col(metric).desc(), tie).limit(1)


def range_of_best(rows: DataFrame, metric: str, other: str) -> DataFrame:
    """One row: the least and greatest other column over rows that reach the best metric."""
    best = rows.agg(F.max(metric).alias("best"))
    return rows.join(F.broadcast(best), F.col(metric) == F.col("best")).agg(F.min(other).alias("low"), F.max(other).alias("high"))


def improvement(value: Column, base: Column) -> Column:
    """Per cent over a base; 0 without one."""
    return F.when(base > 0, (value - base) / base * 100).otherwise(0.0)


def improvement_or_null(value: Column, base: Column) -> Column:
    """Per cent over a base; null if it is 0, so that means leave it out."""
    return F.try_divide(value - base, base) * 100


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def tier(value: Column, tiers: Sequence[tuple[float, str]], rest: str) -> Column:
    """The first tier whose bound value reaches; bounds fall."""
    out = F.lit(rest)
    for bound, name in reversed(tiers):
        out = F.when(value >= bound, name).otherwise(out)
    return out


def baseline_vs_best(rows: DataFrame, key: str, method: str, baseline: str, metric: str) -> DataFrame:
    """key, baseline, best, improvement of the rows' best method over the named one."""
    agg = rows.groupBy(key).agg(F.max(F.when(F.col(method) == baseline, F.col(metric))).alias("baseline"), F.max(metric).alias("best"))
    return agg.withColumn("improvement", improvement(F.col("best"), F.col("baseline")))


def rollup_mean(rows: DataFrame, key: str, metric: str) -> DataFrame:
    """Means of each group and, with a null key, of all."""
    return rows.rollup(key).agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def score_gain(top: DataFrame, base: DataFrame) -> DataFrame:
    """One row: best score of the first run less that of the second."""
    return top.agg(F.max("score").alias("a")).join(F.broadcast(base.agg(F.max("score").alias("b")))).select((F.col("a") - F.col("b")).alias("gain"))


def nested_qrels(qrels: DataFrame) -> DataFrame:
    """query_id, relevant (map of document to judgment)."""
    return qrels.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("corpus_id", "score"))).alias("relevant"))


def nested_run(run: DataFrame) -> DataFrame:
    """query_id, results (array of id and score, best first)."""
    return run.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "corpus_id", "score"))), lambda x: F.struct(x["corpus_id"].alias("corpus_id"), x["score"].alias("score"))).alias("results"))
