"""Evaluators: what answers a question from a context and judges the answer.

An evaluator takes rows of (qid, state, context, question, reference) and gives (qid, state, answer, score). States
of one question that were evaluated before are looked up, not asked again; calls can be counted from what is new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flipgraph.functions import text

KEYS = ["qid", "state"]
#: Share of the reference's tokens that a context must hold for the lexical judge.
ENOUGH = 0.5


class Evaluator:
    """``new`` answers and judges rows; ``evaluate`` asks only for states that ``cache`` lacks."""

    def new(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def evaluate(self, rows: DataFrame, cache: DataFrame | None = None) -> DataFrame:
        once = rows.dropDuplicates(KEYS)
        if cache is None:
            return self.new(once)
        known = once.select(*KEYS).join(cache.select(*KEYS, "answer", "score"), KEYS)
        return known.unionByName(self.new(once.join(cache.select(*KEYS), KEYS, "left_anti")))


class Replay(Evaluator):
    """Recorded answers: (qid, state, answer, score). What was not recorded has nulls."""

    def __init__(self, recorded: DataFrame) -> None:
        self.recorded = recorded

    def new(self, rows: DataFrame) -> DataFrame:
        return rows.select(*KEYS).join(self.recorded.select(*KEYS, "answer", "score"), KEYS, "left")


class Lexical(Evaluator):
    """Answers with the context's line that overlaps the question most, the first of equals; scores by ``lexical_score``."""

    def __init__(self, enough: float = ENOUGH) -> None:
        self.enough = enough

    def new(self, rows: DataFrame) -> DataFrame:
        lines = rows.select(*KEYS, "question", F.posexplode_outer(F.split("context", "\n")).alias("pos", "line"))
        best = lines.groupBy(*KEYS).agg(F.min_by("line", F.struct((-text.token_jaccard(F.col("line"), F.col("question"))).alias("s"), "pos")).alias("answer"))
        score = lexical_score(F.col("context"), F.col("reference"), self.enough)
        return rows.select(*KEYS, score.alias("score")).join(best, KEYS).select(*KEYS, "answer", "score")


class Positional(Evaluator):
    """As ``Lexical``, but earlier lines count more and the answer itself is judged, so that the order of a context matters."""

    def __init__(self, bias: float = 0.1, enough: float = ENOUGH) -> None:
        self.bias, self.enough = bias, enough

    def new(self, rows: DataFrame) -> DataFrame:
        lines = rows.select(*KEYS, "question", F.posexplode_outer(F.split("context", "\n")).alias("pos", "line"))
        near = text.token_jaccard(F.col("line"), F.col("question")) / (1.0 + F.lit(self.bias) * F.col("pos"))
        best = lines.groupBy(*KEYS).agg(F.min_by("line", F.struct((-near).alias("s"), "pos")).alias("answer"))
        judged = rows.select(*KEYS, "reference").join(best, KEYS)
        return judged.select(*KEYS, "answer", lexical_score(F.col("answer"), F.col("reference"), self.enough).alias("score"))


class Callable_(Evaluator):
    """A Python function of lists (contexts, questions, references) that gives (answers, scores), called in batches."""

    def __init__(self, ask: Callable[[list, list, list], tuple[list, list]], state: str = "string") -> None:
        self.ask, self.state = ask, state

    def new(self, rows: DataFrame) -> DataFrame:
        ask = self.ask

        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                answers, scores = ask(f["context"].tolist(), f["question"].tolist(), f["reference"].tolist())
                yield pd.DataFrame({"qid": f["qid"], "state": f["state"], "answer": answers, "score": scores})

        return rows.select(*KEYS, "context", "question", "reference").mapInPandas(part, f"qid long, state {self.state}, answer string, score int")


def lexical_score(context: Column, reference: Column, enough: float = ENOUGH) -> Column:
    """1 if at least ``enough`` of the reference's distinct tokens are in the context; 0 without tokens."""
    r, c = F.array_distinct(text.norm_tokens(reference)), F.array_distinct(text.norm_tokens(context))
    return F.coalesce((F.size(r) > 0) & (F.size(F.array_intersect(r, c)) >= F.lit(enough) * F.size(r)), F.lit(False)).cast("int")


def safe_score(answer: Column) -> Column:
    """The judge's text as 0 or 1; 0 for anything else."""
    return F.coalesce(F.when(F.trim(answer).isin("0", "1"), F.trim(answer).cast("int")), F.lit(0))


def choice_letter(answer: Column) -> Column:
    """The letter of a multiple-choice answer given as JSON or text; empty if none can be read."""
    j = F.get_json_object(answer, "$.answer")
    return F.upper(F.regexp_extract(F.coalesce(j, answer), r"^\s*\(?([A-Ea-e])\b", 1))
