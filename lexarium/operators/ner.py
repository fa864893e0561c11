"""Entity-label arrays: probabilities, labels, confidence filter, sentence search. Models themselves sit behind lexarium.operators.models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions.text import argmax, half_precision, let, softmax


def _literal(names: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in names])


def biased_softmax(logits: Column, biases: list[float] | None = None) -> Column:
    return softmax(logits if biases is None else F.zip_with(logits, F.array(*[F.lit(float(b)) for b in biases]), lambda x, b: x + b))


def best_label(logits: Column, id2label: list[str], min_confidence: dict[str, float] | float | None = None) -> Column:
    """The likeliest label; O if its probability is under the label's threshold (by full name, then by type) or the general one."""
    names = _literal(id2label)

    def pick(p: Column) -> Column:
        label = F.element_at(names, argmax(p) + 1)
        if min_confidence is None:
            return label
        general = min_confidence if not isinstance(min_confidence, dict) else min_confidence.get("*", 0.0)
        by = min_confidence if isinstance(min_confidence, dict) else {}
        need = F.lit(float(general))
        for name, v in by.items():
            if name != "*":
                need = F.when((label == name) | (F.regexp_replace(label, "^[BI]-", "") == name), float(v)).otherwise(need)
        return F.when(F.array_max(p) < need, "O").otherwise(label)

    return let(softmax(logits), pick)


def confidence(logits: Column) -> Column:
    return F.array_max(softmax(logits))


def constrained_labels(logits: Column, id2label: list[str]) -> Column:
    """array<int> for array<array<float>>: from left to right the best label whose step from the one before is legal (I-X only after B-X or I-X). Starts afresh with each sentence."""
    types = [x[2:] if x[:2] in ("B-", "I-") else "" for x in id2label]
    inside = [x.startswith("I-") for x in id2label]
    legal = _literal([",".join(str(int(not inside[j] or types[j] == types[i])) for j in range(len(id2label))) for i in range(len(id2label))])
    start = id2label.index("O") if "O" in id2label else 0

    def step(acc: Column, x: Column) -> Column:
        prev = F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(start))
        ok = F.split(F.element_at(legal, prev + 1), ",")
        allowed = F.zip_with(x, ok, lambda v, o: F.when(o == "1", v.cast("double")))
        best = (F.array_position(allowed, F.array_max(allowed)) - 1).cast("int")
        return F.concat(acc, F.array(best))

    return F.aggregate(logits, F.array().cast("array<int>"), step)


def filter_confidence(labels: Column, confidences: Column, thresholds: dict[str, float]) -> Column:
    """Runs of consecutive labels other than O whose first token is less sure than its label's threshold become O. Runs end with the sentence."""
    table = F.create_map(*[x for k, v in sorted(thresholds.items()) for x in (F.lit(k), F.lit(float(v)))]) if thresholds else None
    if table is None:
        return labels

    def step(acc: Column, x: Column) -> Column:
        opens = (x["l"] != "O") & ~acc["on"]
        drop = F.when(opens, F.coalesce(x["c"] < F.element_at(table, x["l"]), F.lit(False))).otherwise(acc["drop"])
        out = F.when((x["l"] != "O") & drop, "O").otherwise(x["l"])
        return F.struct((x["l"] != "O").alias("on"), drop.alias("drop"), F.concat(acc["out"], F.array(out)).alias("out"))

    start = F.struct(F.lit(False).alias("on"), F.lit(False).alias("drop"), F.array().cast("array<string>").alias("out"))
    items = F.transform(F.arrays_zip(labels.alias("l"), confidences.alias("c")), lambda x: F.struct(x["l"].alias("l"), x["c"].alias("c")))
    return F.aggregate(items, start, step)["out"]


def parse_thresholds(given: list[str]) -> dict[str, float]:
    out = {}
    for item in given:
        label, sep, value = item.rpartition(":")
        if not sep or not label:
            raise ValueError(f"expected LABEL:VALUE, got {item!r}")
        out[label] = float(value)
    return out


def sentences_with(index: DataFrame, labels: str, wanted: list[str], excluded: list[str] = (), allowed: DataFrame | None = None) -> DataFrame:
    """index's rows that have a label of a wanted type and none of an excluded one; allowed (spos) narrows them."""
    kinds = F.transform(labels, lambda x: F.regexp_replace(x, "^[BI]-", ""))
    df = index.where(F.arrays_overlap(kinds, _literal(list(wanted))))
    if excluded:
        df = df.where(~F.arrays_overlap(kinds, _literal(list(excluded))))
    return df if allowed is None else df.join(allowed.select("spos"), "spos", "left_semi")


def convert_index(index: DataFrame, id2label: list[str], logits: str = "logits", with_confidence: bool = True) -> DataFrame:
    """A logits index as a labels index: labels whose steps are legal and, on request, the confidence of the likeliest label in half precision."""
    names = _literal(id2label)
    labels = F.transform(constrained_labels(F.col(logits), id2label), lambda k: F.element_at(names, k + 1))
    out = index.withColumn("labels", labels)
    if with_confidence:
        out = out.withColumn("confidence", F.transform(logits, lambda x: half_precision(confidence(x))))
    return out.drop(logits)
