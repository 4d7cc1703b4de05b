"""Quality metrics and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def averages(rows: DataFrame, measures: list[str], by: str = "system") -> DataFrame:
    """Means by system; negative judge scores don't count."""
    return rows.groupBy(by).agg(*[F.avg(F.when(F.col(m) >= 0, F.col(m))).alias(m) for m in measures])


def breakdown(rows: DataFrame, measure: str) -> DataFrame:
    """Means by system, by system and domain, by system and question type, in one pass."""
    rows.createOrReplaceTempView("_breakdown")
    return rows.sparkSession.sql(f"SELECT system, domain, question_type, count(*) AS n, avg({measure}) AS mean FROM _breakdown GROUP BY GROUPING SETS ((system), (system, domain), (system, question_type))")


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    """A16."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def graded(rows: DataFrame, grade: str = "grade") -> DataFrame:
    """Rates of correct, incorrect and unattempted answers, accuracy of the attempted, F1; 0 where nothing divides."""
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    g = rows.agg(F.count("*").alias("n"), F.count_if(F.col(grade) == "CORRECT").alias("correct"), F.count_if(F.col(grade) == "INCORRECT").alias("incorrect"), F.count_if(F.col(grade) == "NOT_ATTEMPTED").alias("not_attempted"))
    n, c, i, a = F.col("n"), F.col("correct"), F.col("incorrect"), F.col("correct") + F.col("incorrect")
    g = g.select("n", "correct", "incorrect", "not_attempted", share(c, n).alias("correct_rate"), share(i, n).alias("incorrect_rate"), share(F.col("not_attempted"), n).alias("not_attempted_rate"), share(a, n).alias("answer_rate"), share(c, a).alias("accuracy"))
    return g.withColumn("f1", share(2 * F.col("accuracy") * F.col("correct_rate"), F.col("accuracy") + F.col("correct_rate")))


def flagged_rate(rows: DataFrame, flag: str) -> DataFrame:
    """Flagged over evaluated; null flags aren't evaluated, none evaluated gives null."""
    return rows.agg(F.count(flag).alias("evaluated"), F.sum(F.col(flag).cast("int")).alias("flagged"), F.avg(F.col(flag).cast("int")).alias("rate"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum, chosen by the digest of seed and key: the same at any partitioning."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """W18."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).limit(n)


def append_results(results: DataFrame, path: str) -> None:
    """Appends results as JSON lines; an earlier run's files stay."""
    results.write.mode("append").json(path)
