"""Research questions as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsift.schemas import QUESTIONS


def questions_df(spark: SparkSession, questions: list[str]) -> DataFrame:
    """Questions from a config list; an empty or non-list value is rejected."""
    if not isinstance(questions, list) or not questions:
        raise ValueError("'questions' must be a non-empty list")
    return spark.createDataFrame([(i, q) for i, q in enumerate(questions)], QUESTIONS)


def questions_from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Questions held in a table (one row per question)."""
    return df.select(F.col(id_col).cast("long").alias("question_id"),
                     F.col(text_col).alias("question"))
