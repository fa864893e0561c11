"""The boundary to neural models: a model is a picklable factory that executors call once per worker; batches go through Arrow."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions.text import lemma_stub, protect_spans, restore_spans

#: factory() -> function from a list of inputs to a list of outputs of the same length.
Factory = Callable[[], Callable[[list], list]]


def apply_model(rows: DataFrame, column: str, out: str, out_type: str, factory: Factory, batch: int = 32) -> DataFrame:
    """rows plus out: the model's answer for each value of column, in batches, in one pass without a shuffle."""
    given = rows.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.fields) + f", `{out}` {out_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            values, answers = b.column(b.schema.get_field_index(column)).to_pylist(), []
            for k in range(0, len(values), batch):
                answers += model(values[k : k + batch])
            yield pa.record_batch([*b.columns, pa.array(answers)], names=[*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def stub_lemmas(words: Column) -> Column:
    return F.transform(words, lemma_stub)


def translate_sheet(sheet: DataFrame, translate: Factory, source: str = "Label sentence", target: str = "Target", valid_only: bool = True, overwrite: bool = False, protect: bool = True, batch: int = 32) -> DataFrame:
    """sheet with target filled for the selected rows (valid ones without a target, or all with overwrite): tags go, code-switched spans pass through untouched."""
    chosen = (F.trim("Valid") == "+") if valid_only else F.lit(True)
    if not overwrite:
        chosen = chosen & (F.trim(F.coalesce(target, F.lit(""))) == "")
    held = protect_spans(F.col(source)) if protect else F.struct(F.col(source).alias("text"), F.array().cast("array<string>").alias("terms"))
    rows = sheet.withColumn("_held", held).withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    rows = rows.withColumn("_in", F.when(F.col("_chosen"), F.regexp_replace("_held.text", r"</?[A-Za-z]+\d+>", "")))
    answered = apply_model(rows.withColumn("_terms", F.col("_held.terms")).drop("_held"), "_in", "_out", "string", translate, batch)
    answered = answered.withColumn("_back", F.regexp_replace(restore_spans(F.col("_out"), F.col("_terms")), r"</?[A-Za-z]+\d+>", ""))
    new = F.when(F.col("_chosen"), F.col("_back")).otherwise(F.col(target))
    return answered.withColumn(target, new).select(*sheet.columns)


def echo_model() -> Callable[[list], list]:
    """Deterministic stand-in: upper case."""
    return lambda texts: [None if t is None else t.upper() for t in texts]


def noisy_tagger(labels: list[str], seed: int = 1) -> Callable[[], Callable[[list], list]]:
    """Deterministic stand-in tagger: logits drawn from the word's hash."""

    def factory() -> Callable[[list], list]:
        def logits(word: str) -> list[float]:
            rng = random.Random(f"{seed}:{word}")
            return [rng.gauss(0, 1) + (2 if name == "O" else 0) for name in labels]

        return lambda sentences: [[logits(w) for w in words or []] for words in sentences]

    return factory
