"""Choosing candidates: top, stratified, greedy; samples, splits and folds."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def select_top(pool: DataFrame, k: int, score: str = "score_total", tie: tuple[str, ...] = ("spos",)) -> DataFrame:
    """The k best (0: all), by score, then by tie."""
    ranked = pool.orderBy(F.desc(score), *tie)
    return ranked.limit(k) if k else ranked


def strata_of(tag_map: Column) -> Column:
    """The strata that a record belongs to: entity types of NEk:TYPE keys (without B-, I-), else the tags' values."""
    entries = F.map_entries(tag_map)
    kind = lambda e: F.when(e["key"].startswith("NE"), F.when(e["key"].contains(":"), F.regexp_replace(F.get(F.split(e["key"], ":"), F.lit(1)), "^[BI]-", ""))).otherwise(e["value"])
    return F.array_distinct(F.filter(F.transform(entries, kind), lambda x: x.isNotNull()))


def select_stratified(pool: DataFrame, k: int, strata: str, score: str = "score_total", tie: str = "spos") -> DataFrame:
    """Strata in alphabetical order take their quota of best records that no stratum before has taken: k over the number of strata, one more for the first k modulo that many; without filling up. k = 0: all. pool needs the unique column tie.

    Strata beyond the k-th have no quota, and a stratum needs no more than its quota plus what earlier ones may have
    taken, so at most k (k + 1) / 2 pairs (stratum, tie) go to the driver; the chosen rows are joined back.
    """
    slim = pool.select(F.explode(strata).alias("stratum"), score, tie)
    if not k:
        first = slim.groupBy(tie).agg(F.min("stratum").alias("stratum"))
        return pool.join(first, tie)
    every = slim.select("stratum").distinct()
    n, names = every.count(), [r[0] for r in every.orderBy("stratum").limit(k).collect()]
    quota = {s: k // n + (i < k % n) for i, s in enumerate(names)}
    reach, total = [], 0
    for s in names:
        total += quota[s]
        reach.append((s, total))
    best = Window.partitionBy("stratum").orderBy(F.desc(score), tie)
    rank = slim.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    rows = rank.join(F.broadcast(pool.sparkSession.createDataFrame(reach, "stratum string, _reach int")), "stratum").where("_r <= _reach").orderBy("stratum", "_r").collect()
    used, chosen, taken = set(), [], Counter()
    for r in rows:
        if taken[r["stratum"]] < quota[r["stratum"]] and r[tie] not in used:
            used.add(r[tie])
            taken[r["stratum"]] += 1
            chosen.append((r[tie], r["stratum"]))
    ids = pool.sparkSession.createDataFrame(chosen, f"{tie} {pool.schema[tie].dataType.simpleString()}, stratum string")
    return pool.join(F.broadcast(ids), tie)


def greedy_choice(records: list[tuple], max_per_lemma: int = 1) -> list:
    """ids from (id, score, lemmas) in pool order. Lemmas in order of (records, lemma), each once: its best unused record all of whose lemmas are below the limit; the first of equal scores."""
    frequency, having = Counter(), defaultdict(list)
    for k in sorted(range(len(records)), key=lambda k: -records[k][1]):
        frequency.update(records[k][2])
        for lemma in set(records[k][2]):
            having[lemma].append(k)
    uses, free, picks = Counter(), set(range(len(records))), []
    for lemma in sorted(frequency, key=lambda x: (frequency[x], x)):
        open_ = (k for k in having[lemma] if k in free and max(uses[x] for x in records[k][2]) < max_per_lemma)
        if (k := next(open_, None)) is not None:
            free.remove(k)
            uses.update(records[k][2])
            picks.append(records[k][0])
    return picks


def select_greedy(pool: DataFrame, max_per_lemma: int = 1, lemmas: str = "matched_lemmas", score: str = "score_total", tie: str = "spos") -> DataFrame:
    """pool's rows that cover lemmas greedily, plus pick (order of choice). The choice is sequential by nature: it runs in one task over slim rows (id, score, lemmas), which the rows' search has narrowed to candidates of the requested lemmas."""
    kind = pool.schema[tie].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(tie)
        ids = greedy_choice([(a, b, list(c)) for a, b, c in zip(pdf[tie], pdf[score], pdf[lemmas], strict=True)], max_per_lemma)
        return pd.DataFrame({tie: ids, "pick": range(len(ids))})

    picked = pool.select(tie, score, lemmas).groupBy().applyInPandas(run, f"{tie} {kind}, pick int")
    return pool.join(picked, tie)


def selection_summary(selected: DataFrame, pool: DataFrame, lemmas: str = "matched_lemmas", max_per_lemma: int = 1) -> DataFrame:
    """One row: pool, selected, lemmas, covered, saturated, avg_density, multi."""
    one = selected.select(F.explode(lemmas).alias("l")).groupBy("l").count()
    covered = one.agg(F.count("*").alias("covered"), F.count_if(F.col("count") >= max_per_lemma).alias("saturated"))
    size = selected.agg(F.count("*").alias("selected"), F.avg(F.size(lemmas)).alias("avg_density"), F.count_if(F.size(lemmas) > 1).alias("multi"))
    total = pool.agg(F.count("*").alias("pool"))
    distinct = pool.select(F.explode(lemmas).alias("l")).agg(F.countDistinct("l").alias("lemmas"))
    return total.crossJoin(size).crossJoin(distinct).crossJoin(covered)  # one row each


def dedup_best(rows: DataFrame, key: Column, score: str = "score_total", tie: str = "spos") -> DataFrame:
    """One row per key: the best score, then the least tie. Aggregates before the shuffle, so a key that is everywhere stays cheap."""
    best = rows.groupBy(F.xxhash64(key).alias("_k"), key.alias("_key")).agg(F.max_by(tie, F.struct(F.col(score), -F.col(tie))).alias(tie))
    return rows.join(best.select(tie), tie, "left_semi")


def sentence_sample(spark: SparkSession, n: int, k: int | None, sequential: bool = False, seed: int = 42) -> DataFrame:
    """spos of the first k, or k random, of n sentences (None: all). A random draw is made on the driver: k numbers."""
    if k is None or k >= n:
        return spark.range(n).withColumnRenamed("id", "spos")
    if sequential:
        return spark.range(k).withColumnRenamed("id", "spos")
    drawn = np.sort(np.random.default_rng(seed).choice(n, size=k, replace=False))
    return spark.createDataFrame([(int(x),) for x in drawn], "spos bigint")


def md5_order(key: Column, seed: int = 42) -> Column:
    """A pseudorandom order of keys that any engine with md5 can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def hash_split(rows: DataFrame, key: str, test_percent: int = 20, seed: int = 42) -> DataFrame:
    """rows plus split: test for about test_percent of the keys, the same on every run and for every partitioning."""
    draw = F.conv(F.substring(md5_order(F.col(key), seed), 1, 8), 16, 10).cast("bigint")
    return rows.withColumn("split", F.when(draw % 100 < test_percent, "test").otherwise("train"))


def shuffled(rows: DataFrame, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """rows in pseudorandom order of key, the first n of them if n is given; equal keys keep together."""
    mixed = rows.orderBy(md5_order(F.col(key), seed), key)
    return mixed if n is None else mixed.limit(n)


def reduced_matches(matches: DataFrame, query: str, keys: list[str], limits: dict[str, int], seed: int = 42) -> DataFrame:
    """One row per match of every query; a query with a limit keeps that many, drawn by seed."""
    if not limits:
        return matches
    most = F.element_at(F.create_map(*[x for k, n in limits.items() for x in (F.lit(k), F.lit(n))]), F.col(query))
    at = F.row_number().over(Window.partitionBy(query).orderBy(md5_order(F.concat_ws(":", *keys), seed), *keys))
    return matches.withColumn("_r", at).where(most.isNull() | (most <= 0) | (F.col("_r") <= most)).drop("_r")


def kfold(spark: SparkSession, n: int, k: int, seed: int = 42) -> DataFrame:
    """pos, fold: a permutation cut into k equal folds, the last with the remainder. For labelled sets: the driver draws the permutation (ten bytes a row) and sends two bytes a row to the executors, which make the rows; more than 2^27 rows are refused."""
    if n > 1 << 27:
        raise ValueError(f"{n} rows are too many for a permutation on the driver; use hash_split")
    size = n // k
    folds = np.empty(n, dtype=np.int16)
    folds[np.random.default_rng(seed).permutation(n)] = np.minimum(np.arange(n) // size, k - 1) if size else k - 1
    sent = spark.sparkContext.broadcast(folds)

    def run(batches):
        for b in batches:
            pos = b.column(0).to_numpy()
            yield pa.record_batch([b.column(0), pa.array(sent.value[pos], pa.int32())], names=["pos", "fold"])

    return spark.range(n).withColumnRenamed("id", "pos").mapInArrow(run, "pos bigint, fold int")


def class_weights(rows: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """label, n, weight: total / (classes * n), 1 for a class without rows."""
    dim = rows.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    all_ = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy())
    return F.broadcast(dim).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(all_ / (len(classes) * F.col("n"))).alias("weight"))
