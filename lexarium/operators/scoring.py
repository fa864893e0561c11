"""Gates and Gaussian multi-criteria scores of sentences, as Column expressions over masks."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions.text import is_alnum


@dataclass(frozen=True)
class ScoringConfig:
    """Gates first, then mean and width of each criterion, then weights (normalised when used). Names and defaults are fixed values: they are those of the configuration format."""

    min_tokens: int = 0
    max_tokens: int = 9999
    min_alpha_ratio: float = 0.0
    filter_require_loanword: bool = False
    filter_require_code_switch: bool = False
    filter_require_named_entity: bool = False
    filter_forbid_loanword: bool = False
    filter_forbid_code_switch: bool = False
    filter_forbid_named_entity: bool = False
    filter_require_context_lang: bool = False
    filter_require_span_lang: bool = False
    ner_ignore_labels: frozenset[str] = field(default_factory=frozenset)
    filter_min_loanword_density: float = 0.0
    filter_min_code_switch_density: float = 0.0
    filter_min_named_entity_density: float = 0.0
    length_mu: float = 20.0
    length_sigma: float = 10.0
    loanword_mu: float = 0.15
    loanword_sigma: float = 0.10
    code_switch_mu: float = 0.15
    code_switch_sigma: float = 0.10
    named_entity_mu: float = 0.15
    named_entity_sigma: float = 0.10
    weight_length: float = 0.0
    weight_alpha: float = 0.0
    weight_loanword: float = 0.0
    weight_code_switch: float = 0.0
    weight_named_entity: float = 0.0

    def weights(self) -> dict[str, float]:
        raw = {k: getattr(self, f"weight_{k}") for k in CRITERIA}
        total = sum(raw.values())
        return {k: v / total for k, v in raw.items()} if total else dict.fromkeys(CRITERIA, 1 / len(CRITERIA))


CRITERIA = ("length", "alpha", "loanword", "code_switch", "named_entity")
MASKS = ("loanword", "code_switch", "named_entity")

#: The defaults of the three kinds of query.
PROFILES: dict[str, dict[str, Any]] = {
    "lemmas": {
        "min_tokens": 8, "max_tokens": 128, "min_alpha_ratio": 0.5, "filter_require_loanword": True, "filter_forbid_named_entity": True,
        "weight_length": 0.4, "weight_alpha": 0.4, "weight_loanword": 0.2, "length_mu": 30, "length_sigma": 10, "loanword_mu": 0.30, "loanword_sigma": 0.15,
    },
    "code-switch": {
        "min_tokens": 5, "max_tokens": 128, "min_alpha_ratio": 0.5, "filter_require_code_switch": True, "filter_forbid_named_entity": True,
        "filter_require_context_lang": True, "filter_require_span_lang": True,
        "weight_code_switch": 0.33, "weight_length": 0.33, "weight_alpha": 0.33, "length_mu": 30, "length_sigma": 10, "code_switch_mu": 0.30, "code_switch_sigma": 0.15,
    },
    "ner": {
        "min_tokens": 5, "max_tokens": 128, "min_alpha_ratio": 0.5, "filter_require_named_entity": True,
        "weight_length": 0.4, "weight_alpha": 0.4, "weight_named_entity": 0.2, "length_mu": 30, "length_sigma": 10, "named_entity_mu": 0.30, "named_entity_sigma": 0.15,
    },
}


def scoring_config(profile: str, toml: str | None = None, **changes: Any) -> ScoringConfig:
    """Defaults, then the profile, then [scoring], then [scoring.profiles.<profile>], then changes. Unknown keys and a criterion both required and forbidden are errors."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}; one of {sorted(PROFILES)}")
    given = dict(PROFILES[profile])
    if toml:
        table = dict(tomllib.loads(toml).get("scoring", {}))
        own = table.pop("profiles", {}).get(profile, {})
        given |= table | own
    given |= changes
    kinds = {f.name: f.type for f in fields(ScoringConfig)}
    if unknown := sorted(given.keys() - kinds.keys()):
        raise ValueError(f"unknown scoring keys: {unknown}")
    cast = {"int": int, "float": float, "bool": bool}
    cfg = replace(ScoringConfig(), **{k: cast[kinds[k]](v) if kinds[k] in cast else frozenset(v) for k, v in given.items()})
    for k in MASKS:
        if getattr(cfg, f"filter_require_{k}") and getattr(cfg, f"filter_forbid_{k}"):
            raise ValueError(f"{k} is both required and forbidden")
    return cfg


def loanword_mask(tokens: Column, lemmas: list[str]) -> Column:
    """array<int>: 1 where the lower-case lemma is listed."""
    wanted = F.array(*[F.lit(x) for x in sorted({x.lower() for x in lemmas})]) if lemmas else F.array().cast("array<string>")
    return F.transform(tokens, lambda t: F.array_contains(wanted, F.lower(t["lemma"])).cast("int"))


def entity_mask(tokens: Column) -> Column:
    """Without entity labels: upper-case nouns after the first word."""
    return F.transform(tokens, lambda t, i: ((i > 0) & t["word"].rlike(r"^\p{Lu}") & t["pos"].startswith("n")).cast("int"))


def score_mask(scores: Column, threshold: float, n: Column) -> Column:
    return F.transform(F.slice(scores, F.lit(1), n), lambda s: (s > threshold).cast("int"))


def label_mask(labels: Column, n: Column, ignored: set[str] = frozenset(), excluded: set[str] = frozenset()) -> Column:
    """1 where the label is not O and its type is neither ignored nor excluded."""
    off = F.array(*[F.lit(x) for x in sorted({"O"} | set(ignored) | set(excluded))])
    return F.transform(F.slice(labels, F.lit(1), n), lambda x: (~F.array_contains(off, F.regexp_replace(x, "^[BI]-", "")) & (x != "O")).cast("int"))


def _gaussian(x: Column, mu: float, sigma: float) -> Column:
    return F.exp(-F.pow(x - F.lit(float(mu)), F.lit(2.0)) / F.lit(2.0 * float(sigma) ** 2))


def score_sentences(rows: DataFrame, cfg: ScoringConfig, masks: dict[str, Column], tokens: str = "tokens", context_lang: Column | None = None, span_lang: Column | None = None, lang: str | None = None) -> DataFrame:
    """rows plus filter_reason (null if it passes), filtered and score_length, _alpha, _loanword, _code_switch, _named_entity, _total (0 if filtered). The first failing gate names the reason."""
    if (cfg.filter_require_context_lang or cfg.filter_require_span_lang) and lang is None:
        raise ValueError("language gates need lang")
    n = F.size(tokens)
    share = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x) / n
    zero = F.when(n > 0, F.lit(0.0))
    density = {f"_{k}": F.when(n > 0, share(masks[k])) if k in masks else zero for k in MASKS}
    alpha = F.when(n > 0, F.size(F.filter(tokens, lambda t: is_alnum(t["word"]))) / n)
    df = rows.withColumns({"_alpha": alpha, **density})
    none = F.lit(None).cast("string")
    gates = [("empty", n == 0), ("too_short", n < cfg.min_tokens), ("too_long", n > cfg.max_tokens), ("low_alpha", F.col("_alpha") < cfg.min_alpha_ratio)]
    if cfg.filter_require_context_lang:
        gates.append(("wrong_context_language", ~(context_lang if context_lang is not None else none).eqNullSafe(F.lit(lang))))
    if cfg.filter_require_span_lang:
        span = span_lang if span_lang is not None else none
        gates += [("span_lang_undetected", span.isNull()), ("span_not_foreign", span == lang)]
    names = {"loanword": "loanwords", "code_switch": "code_switch", "named_entity": "named_entities"}
    gates += [(f"zero_{names[k]}", F.col(f"_{k}") == 0) for k in MASKS if getattr(cfg, f"filter_require_{k}")]
    gates += [(f"forbidden_{names[k]}", F.col(f"_{k}") > 0) for k in MASKS if getattr(cfg, f"filter_forbid_{k}")]
    gates += [(f"{k}_density_below_min", F.col(f"_{k}") < getattr(cfg, f"filter_min_{k}_density")) for k in MASKS]
    reason = F.when(gates[0][1], gates[0][0])
    for name, fails in gates[1:]:
        reason = reason.when(fails, name)
    df = df.withColumn("filter_reason", reason).withColumn("filtered", F.col("filter_reason").isNotNull())
    parts = {"length": _gaussian(n, cfg.length_mu, cfg.length_sigma), "alpha": F.col("_alpha")} | {k: _gaussian(F.col(f"_{k}"), getattr(cfg, f"{k}_mu"), getattr(cfg, f"{k}_sigma")) for k in MASKS}
    df = df.withColumns({f"score_{k}": F.when(F.col("filtered"), 0.0).otherwise(c) for k, c in parts.items()})
    total = sum((F.lit(w) * F.col(f"score_{k}") for k, w in cfg.weights().items()), F.lit(0.0))
    return df.withColumn("score_total", total).drop("_alpha", *density)
