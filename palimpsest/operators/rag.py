"""Question answering over chunks: prompts, a provider hook, and the experiment grid.

Models are outside this engine. A provider is a function of a prompt that gives a reply; without one, the answers are an input table.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metrics

SEPARATOR = "\n\n---\n\n"
#: Wording of our own; what matters is the order: context, question, the abstention word, a JSON reply with answer and confidence.
PROMPT = "Use only the passages below; they may hold recognition errors.\n\nCONTEXT:\n%s\n\nQUESTION: %s\n\nIf they don't say, answer INSUFFICIENT_CONTEXT. Reply as JSON with the keys answer and confidence (0-100)."


def prompt(context: Column, question: Column) -> Column:
    return F.format_string(PROMPT, context, question)


def contexts(hits: DataFrame, k: int = 5) -> DataFrame:
    """qid, context: the texts of each query's k best chunks (qid, rank, text) in order."""
    best = hits.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))  # k rows a query
    return best.select("qid", F.array_join("c.text", SEPARATOR).alias("context"))


def ask(prompts: DataFrame, provider: Callable[[str], str]) -> DataFrame:
    """prompts with reply; an exception becomes an 'ERROR: ...' reply, as an answer of confidence 0."""

    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            try:
                return provider(x)
            except Exception as e:  # noqa: BLE001  the reply says what happened
                return f"ERROR: {e}"

        return p.map(one)

    return prompts.withColumn("reply", run("prompt"))


def read_replies(rows: DataFrame) -> DataFrame:
    """rows (reply) with prediction and confidence."""
    answer, confidence = T.llm_answer(F.col("reply"))
    failed = F.col("reply").startswith("ERROR: ")
    return rows.withColumn("prediction", F.when(failed, F.col("reply")).otherwise(answer)).withColumn("confidence", F.when(failed, F.lit(0)).otherwise(confidence))


def experiment(answers: DataFrame) -> DataFrame:
    """Summary for each configuration and tier (null: all tiers) of answers (config, tier, prediction, answer, confidence)."""
    rows = metrics.answers(answers)
    return metrics.rag_summary(rows, "config").withColumn("tier", F.lit(None).cast("string")).unionByName(metrics.rag_summary(rows, "config", "tier"))
