"""Labelled questions and guardrail cases: defaults are filled in, and rows that contradict themselves are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(df: DataFrame, name: str, default: Column) -> Column:
    """The column, with the default where it is null or there is none."""
    return F.coalesce(F.col(name), default) if name in df.columns else default


def question_faults(questions: DataFrame) -> DataFrame:
    """id and fault of each question whose gold does not go with what is expected. Null ids are faults too."""
    size = F.size(_column(questions, "gold", F.array().cast("array<string>")))
    fault = (
        F.when(F.col("id").isNull(), "no id")
        .when(F.coalesce(~F.col("expect").isin("answer", "refuse"), F.lit(True)), "expect must be answer or refuse")
        .when((F.col("expect") == "answer") & (size == 0), "expect=answer requires gold docs")
        .when((F.col("expect") == "refuse") & (size > 0), "expect=refuse must have empty gold")
    )
    return questions.select("id", fault.alias("fault")).where("fault is not null")


def case_faults(cases: DataFrame) -> DataFrame:
    """id and fault of each case that expects neither block nor pass; what the gate is to do comes first."""
    gate, expect = (_column(cases, x, F.lit("")) for x in ("gate_expect", "expect"))
    named = F.when(gate != "", F.lit("gate_expect")).otherwise(F.lit("expect"))
    wrong = ~F.when(gate != "", gate).otherwise(expect).isin("block", "pass")
    return cases.select("id", F.when(wrong, F.concat(named, F.lit(" must be block|pass"))).alias("fault")).where("fault is not null")


def _sound(faults: DataFrame) -> None:
    found = faults.limit(3).collect()
    if found:
        raise ValueError("; ".join(f"{r.id}: {r.fault}" for r in found))


def load_questions(questions: DataFrame) -> DataFrame:
    """The questions, gold empty where it is missing; raises for those with a fault."""
    _sound(question_faults(questions))
    return questions.withColumn("gold", _column(questions, "gold", F.array().cast("array<string>")))


def load_cases(cases: DataFrame) -> DataFrame:
    """The cases, known_limit false and answer empty where they are missing; raises for those with a fault."""
    _sound(case_faults(cases))
    return cases.withColumns({"known_limit": _column(cases, "known_limit", F.lit(False)), "answer": _column(cases, "answer", F.lit(""))})
