"""Pipelines of named steps, and parts of one's own under names: signals, metrics, embeddings, tools."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass(frozen=True)
class Step:
    """What a pipeline does under a name, and the columns it needs."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()


def run_steps(df: DataFrame, steps: Sequence[Step], go_on: bool = False) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The table that the steps make of df, and (name, "done" or what was wrong) of each.

    Steps only build the plan, so what is wrong here are columns and types. A
    step that fails ends the pipeline, unless go_on: then it is left out.
    """
    log = []
    for step in steps:
        missing = [c for c in step.needs if c not in df.columns]
        try:
            if missing:
                raise ValueError(f"{step.name} needs {', '.join(missing)}")
            df = step.apply(df)
            log.append((step.name, "done"))
        except (ValueError, PySparkException) as wrong:
            log.append((step.name, str(wrong).splitlines()[0]))
            if not go_on:
                raise
    return df, log


def ingestion(embed: Callable[[Column], Column], size: int = 512, overlap: int = 64) -> list[Step]:
    """Texts in lower case with single spaces, cut into windows, each with the vector that `embed` gives it."""
    clean = Step("clean", lambda d: d.withColumn("text", tx.prepared(F.col("text"), ("spaces", "lower"))), ("text",))
    chunk = Step("chunk", lambda d: d.select(*(c for c in d.columns if c != "text"), F.posexplode(tx.cut_fixed(F.col("text"), size, overlap)).alias("chunk_index", "chunk")), ("text",))
    return [clean, chunk, Step("embed", lambda d: d.withColumn("embedding", embed(F.col("chunk"))), ("chunk",))]


class Registry:
    """Functions under names; parts that are plugged in are looked up where a name is given."""

    def __init__(self) -> None:
        self._known: dict[str, Callable] = {}

    def add(self, name: str):
        def keep(f: Callable) -> Callable:
            if name in self._known:
                raise ValueError(f"{name} is known already")
            self._known[name] = f
            return f

        return keep

    def __getitem__(self, name: str) -> Callable:
        if name not in self._known:
            raise KeyError(f"{name} is not one of {', '.join(self._known)}")
        return self._known[name]

    def names(self) -> list[str]:
        return list(self._known)

    def columns(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        """df with a column for each of these functions of a row (no arguments, a Column)."""
        return df.withColumns({n: self[n]() for n in names})

    def call(self, calls: DataFrame, name: str = "tool") -> DataFrame:
        """calls with the result of the tool that each row names, and an error where there is none such or it gives nothing. Tools are functions of no arguments that read the row's columns."""
        result = F.when(F.lit(False), F.lit(None).cast("double"))
        for n, f in self._known.items():
            result = result.when(F.col(name) == n, f())
        known = F.coalesce(F.col(name).isin(*self._known), F.lit(False))
        return calls.withColumn("result", result).withColumn("error", F.when(~known, "unknown tool").when(F.col("result").isNull(), "no result"))


CALCULATOR = Registry()
CALCULATOR.add("add")(lambda: F.col("a") + F.col("b"))
CALCULATOR.add("subtract")(lambda: F.col("a") - F.col("b"))
CALCULATOR.add("multiply")(lambda: F.col("a") * F.col("b"))
CALCULATOR.add("divide")(lambda: F.try_divide(F.col("a"), F.col("b")))
