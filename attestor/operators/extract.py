"""Model calls as a batched, pluggable operator with validation and one repair; admission of extracted facts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.text import json_id

FENCE = re.compile(r"^\s*```(?:json)?\s*|\s*```\s*$")


def call(rows: DataFrame, model: Callable[[list[str]], list[str]], check: Callable[[object], str | None], batch: int = 3) -> DataFrame:
    """request_id, prompt -> request_id, payload, attempts, error. A reply that isn't valid JSON, or that `check` finds
    a fault in, is asked for once more with the fault; what is wrong after that is an error row, not an exception."""

    def judged(reply: str) -> tuple[str | None, str | None]:
        try:
            value = json.loads(FENCE.sub("", reply))
        except ValueError:
            return None, "invalid_json"
        fault = check(value)
        return (None, fault) if fault else (json.dumps(value, sort_keys=True, ensure_ascii=False), None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found = [judged(r) for r in model(part["prompt"].tolist())]
                bad = [i for i, (_, fault) in enumerate(found) if fault]
                again = dict(zip(bad, model([f"{part['prompt'].iloc[i]}\n{found[i][1]}" for i in bad]), strict=True)) if bad else {}
                out = [(r, *(judged(again[i]) if i in again else found[i]), 1 + (i in again)) for i, r in enumerate(part["request_id"])]
                yield pd.DataFrame([(r, p, n, e) for r, p, e, n in out], columns=["request_id", "payload", "attempts", "error"])

    return rows.select("request_id", "prompt").mapInPandas(run, "request_id string, payload string, attempts int, error string")


def admit(drafts: DataFrame, types: DataFrame, chunks: DataFrame, processor: str = "1") -> tuple[DataFrame, DataFrame]:
    """(facts with ids, rejected counts): the type is registered, the chunk is of the batch, each fact once."""
    known = drafts.join(types.select("fact_type").withColumn("_type", F.lit(True)), "fact_type", "left").join(chunks.select("chunk_id").withColumn("_chunk", F.lit(True)), "chunk_id", "left")
    reason = F.when(F.col("_type").isNull(), "unknown_type").when(F.col("_chunk").isNull(), "unknown_chunk")
    known = known.withColumn("_reason", reason).drop("_type", "_chunk")
    good = known.where("_reason is null").drop("_reason")
    atom = {c: F.col(c) for c in ("subject", "predicate", "object_value")}
    facts = good.withColumn("fact_id", json_id("tf_", company=F.col("company_id"), chunk=F.col("chunk_id"), type=F.col("fact_type"), processor=F.lit(processor), **atom)).dropDuplicates(["fact_id"])
    return facts, known.where("_reason is not null").groupBy("_reason").agg(F.count("*").alias("n")).withColumnRenamed("_reason", "reason")


def batch_report(results: DataFrame) -> DataFrame:
    """Calls, failures and errors of a run."""
    return results.agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if((F.col("attempts") > 1) & F.col("error").isNull()).alias("repaired"), F.bool_and(F.col("attempts") == 1).alias("all_first_valid"), F.bool_and(F.col("error").isNull()).alias("all_ok"))
