"""Answering and judging of question tables on the executors, with resume.

An answering run goes over the questions that have no good answer yet, slice by slice
(``slices``). An error is a row too, with the error in it; the next run tries it again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fragments import stitch
from ..sources.shared import importable
from .slices import SLICE, Slices

#: Characters of an error message that are kept.
MESSAGE = 500

#: What an answer holds besides the question's own columns.
ANSWER = T.StructType(
    [
        T.StructField("pred_answer", T.StringType()),
        T.StructField("total_cost", T.DoubleType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("loops", T.LongType()),
        T.StructField("trajectory", T.ArrayType(T.StringType())),
        T.StructField("error", T.StringType()),
    ]
)
_ZERO = {"total_cost": 0.0, "input_tokens": 0, "output_tokens": 0, "loops": 0, "trajectory": []}


def mapped(rows: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: T.StructType, failed: Callable[[dict, Exception], dict]) -> DataFrame:
    """rows with the columns of schema that a function gives for each of them; make is
    called once a task, so clients are made where they are used. A row that raises gets
    what failed says of the error."""
    importable(rows.sparkSession)
    out = T.StructType([*rows.schema.fields, *schema.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                try:
                    found.append(call(row))
                except Exception as e:
                    found.append(failed(row, e))
            told = {f.name: pd.Series([r.get(f.name) for r in found], batch.index, object) for f in schema}
            yield batch.assign(**told)[out.names]

    return rows.mapInPandas(run, out)


def answered(questions: DataFrame, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """questions with the columns of ANSWER. make() gives a function of a question's row to a
    dictionary with answer and any of the counts; an empty answer, or one that begins with
    ``Error:``, is an error."""

    def made() -> Callable[[dict], dict]:
        ask = make()

        def one(row: dict) -> dict:
            said = ask(row)
            answer = str(said.get("answer") or "").strip()
            if not answer or answer.startswith("Error:"):
                raise RuntimeError(answer or "the answer is empty")
            return {**_ZERO, **{k: v for k, v in said.items() if k in _ZERO}, "pred_answer": answer}

        return one

    def failed(_: dict, e: Exception) -> dict:
        return {**_ZERO, "pred_answer": f"Error: {e}"[:MESSAGE], "error": str(e)[:MESSAGE]}

    return mapped(questions, made, ANSWER, failed)


def judged(cases: DataFrame, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """cases (question, generated, reference) with score and reasoning by a judge, a function
    of a prompt; a reply that can't be read or an error scores 0."""
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("reasoning", T.StringType())])

    def made() -> Callable[[dict], dict]:
        judge = make()

        def one(case: dict) -> dict:
            said = judge(f"Question: {case['question']}\nReference answer: {case['reference']}\nAnswer: {case['generated']}\nReply with JSON: correct (true or false), reasoning.")
            return verdict(said)

        return one

    return mapped(cases, made, schema, lambda _, e: {"score": 0.0, "reasoning": f"Error: {e}"[:MESSAGE]})


def verdict(said: str) -> dict:
    """score and reasoning of a judge's reply: its JSON, else the first of the words true and
    false in it."""
    import json

    text = stitch([re.sub(r"^\s*```(?:json)?|```\s*$", "", said)])
    value = json.loads(text) if text else None
    told = value.get("correct") if isinstance(value, dict) else None
    words = said.lower()
    correct = told if isinstance(told, bool) else True if "true" in words else False if "false" in words else None
    reason = str(value.get("reasoning", "")) if isinstance(value, dict) else ""
    return {"score": float(bool(correct)), "reasoning": reason if correct is not None else "the reply can't be read"}


class Answers(Slices):
    """The results of answering runs below a folder."""

    def completed(self, identity: dict[str, str], key: str = "qid") -> DataFrame | None:
        """Keys with an answer that is no error, given by the same models on the same data."""
        rows = self.rows()
        if rows is None:
            return None
        same = F.col("error").isNull() & ~F.col("pred_answer").startswith("Error:")
        for name, value in identity.items():
            same = same & (F.col(name) == value)
        return rows.where(same).select(key).distinct()

    def latest(self, key: str = "qid") -> DataFrame:
        """One row a key: its last good one, or the last error if there is none."""
        rows = self.rows()
        pick = F.struct(F.col("error").isNull().alias("good"), "entry", *[c for c in rows.columns if c not in (key, "entry", "trajectory", "error")], "trajectory", "error")
        return rows.groupBy(key).agg(F.max_by(pick, F.struct(F.col("error").isNull(), "entry")).alias("r")).select(key, "r.*").drop("good", "entry")

    def run(self, questions: DataFrame, make: Callable[[], Callable[[dict], dict]], identity: dict[str, str], key: str = "qid", limit: int | None = None, size: int = SLICE) -> dict[str, int]:
        """Answers what is not completed under identity, in the order of keys, at most limit
        of them; counts of answered (errors too), failed and all questions. A question that
        another run has answered meanwhile is left to it."""

        def work(todo: DataFrame) -> DataFrame:
            rows = answered(todo, make)
            for column, value in identity.items():
                rows = rows.withColumn(column, F.lit(value))
            return rows

        n, failed = self.sliced(questions, key, work, lambda: self.completed(identity, key), "error is null", limit, size)
        return {"answered": n, "failed": failed, "total": questions.count()}
