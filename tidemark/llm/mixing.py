"""Records of several sources mixed to target weights, small sources repeated up to a limit, actual shares reported.

Weights come from temperature: the shares that the sources have of all tokens are exponentiated and scaled, and the
exponent is bisected. Without targets, it is the exponent at which the shares have a wanted entropy. With targets, the
weight of a source is share ** exponent * target ** (1 - exponent), scaled: at 0 it is the target, at 1 every document is
repeated alike. The least exponent is taken at which no source must be repeated beyond its limit; a source whose target
itself asks for more gives all it may, and the rest of the weight goes to the others by the same rule. Weights become
token budgets, and budgets whole passes over a source plus the head of a block permutation of it: blocks in hashed
order, documents in hashed order within blocks, placed by prefix sums over block totals.

Defined results: spellings of a source are one; a listed source without documents gets nothing; documents of no source
or of a source a mix doesn't list are in none; documents of no token are left out; a document is used at most
max_repeats times; a budget no source can fill stays short. Targets that don't add up to 1 are scaled; null or negative
targets count as 0; repeated (mix, source) rows add up, with the greatest limit.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

BLOCK = 2048
_WEIGHTS = "mix_name string, source string, target_share double, weight double, exponent double, budget double, passes bigint, rest double"


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def tempered(shares: list[float], exponent: float) -> list[float]:
    raised = [p**exponent if p > 0 else 0.0 for p in shares]
    total = sum(raised)
    return [x / total for x in raised] if total else raised


def exponent_for_entropy(shares: list[float], target: float) -> float:
    """The exponent in [0, 64] whose tempered shares have the target entropy, or the nearer end."""
    low, high = 0.0, 64.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tempered(shares, mid)) > target else (low, mid)
    return (low + high) / 2


def blended(shares: list[float], targets: list[float], exponent: float) -> list[float]:
    """Source shares tempered towards the targets: share ** exponent * target ** (1 - exponent), scaled."""
    raised = [p**exponent * t ** (1 - exponent) if p > 0 and t > 0 else 0.0 for p, t in zip(shares, targets)]
    total = sum(raised)
    return [x / total for x in raised] if total else raised


def limited_weights(shares: list[float], targets: list[float], limits: list[float]) -> tuple[list[float], float]:
    """Weights within the limits, and the exponent of the sources that are not at theirs.

    Sources whose target exceeds their limit are set to it. Then the least exponent is bisected at which the others hold
    theirs; where even 1 doesn't do, those that exceed theirs at 0 are set as well, and so on.
    """
    weights = [0.0] * len(shares)
    free = [i for i, (p, t) in enumerate(zip(shares, targets)) if p > 0 and t > 0]
    rest, exponent = 1.0, 0.0

    def fix(over: list[int]) -> None:
        nonlocal rest
        for i in over:
            weights[i] = limits[i]
            rest -= limits[i]
            free.remove(i)

    fix([i for i in free if targets[i] > limits[i]])
    while free and rest > 1e-12:
        at = lambda e: [rest * w for w in blended([shares[i] for i in free], [targets[i] for i in free], e)]
        over = lambda e: [i for i, w in zip(free, at(e)) if w > limits[i] * (1 + 1e-12)]
        if not over(0.0):
            exponent = 0.0
        elif over(1.0):
            fix(over(0.0))
            continue
        else:
            low, high = 0.0, 1.0
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (mid, high) if over(mid) else (low, mid)
            exponent = high
        for i, w in zip(free, at(exponent)):
            weights[i] = w
        return weights, exponent
    return weights, 1.0


def _shares(tokens: list[float]) -> list[float]:
    total = sum(tokens)
    return [n / total if total else 0.0 for n in tokens]


def _solve(mix: pd.DataFrame) -> pd.DataFrame:
    mix = mix.sort_values("source")
    budget = float(mix["budget"].iloc[0] or 0)
    targets = mix["target_share"].clip(lower=0).fillna(0).tolist()
    total = sum(targets)
    targets = [t / total for t in targets] if total else targets
    tokens = mix["tokens"].fillna(0).tolist()
    limits = [(r * n / budget if budget else 0.0) for r, n in zip(mix["max_repeats"].fillna(1).clip(lower=0), tokens)]
    weights, exponent = limited_weights(_shares(tokens), targets, limits)
    out = []
    for name, source, t, w, n, r in zip(mix["mix_name"], mix["source"], targets, weights, tokens, mix["max_repeats"].fillna(1)):
        quota = w * budget
        passes = min(int(quota // n), int(r)) if n else 0
        rest = quota - passes * n if passes < r else 0.0
        out.append((name, source, t, w, exponent, budget, passes, rest))
    return pd.DataFrame(out, columns=["mix_name", "source", "target_share", "weight", "exponent", "budget", "passes", "rest"])


def source_key(source):
    return F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), r"[\s_]+", "-")


def _wanted(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and listed source: target, limit, tokens and the budget of the mix."""
    totals = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    wanted = targets.select("mix_name", source_key("source").alias("source"), "target_share", "max_repeats", "budget_ratio").where("mix_name is not null and source is not null")
    wanted = wanted.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("budget_ratio").alias("budget_ratio"))
    ratio = F.max("budget_ratio").over(Window.partitionBy("mix_name"))
    rows = wanted.withColumn("budget_ratio", ratio).join(totals, "source", "left")
    rows = rows.withColumn("budget", F.coalesce(F.col("budget_ratio"), F.lit(1.0)) * F.lit(float(everything)))
    return rows.select("mix_name", "source", "target_share", "max_repeats", "tokens", "budget")


def mix_weights(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target, weight, exponent, budget, whole passes and tokens of the last, partial one."""
    return _wanted(sizes, targets).groupBy("mix_name").applyInPandas(_solve, _WEIGHTS)


def permuted(sizes: DataFrame, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """Documents with the tokens that stand before them in their source's block permutation."""
    counts = sizes.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).alias("blocks"))
    placed = sizes.join(counts, "source").select("doc_id", "source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h"), "blocks")
    placed = placed.withColumn("block", F.pmod("h", "blocks")).drop("blocks")
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "block", F.coalesce(F.sum("block_tokens").over(earlier), F.lit(0)).alias("block_start"))
    inner = Window.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("inner_start", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return within.join(starts, ["source", "block"]).select("doc_id", "source", "n_tokens", (F.col("block_start") + F.col("inner_start")).alias("before"))


def mixed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, repeats) for every document a mix uses."""
    sizes = stored(sizes.where("n_tokens > 0").select("doc_id", "source", "n_tokens"))
    weights = mix_weights(sizes, targets)
    order = permuted(sizes.where("source is not null"))
    repeats = F.col("passes") + F.when(F.col("before") + F.col("n_tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    return order.join(weights, "source").withColumn("repeats", repeats).where("repeats > 0").select("mix_name", "source", "doc_id", "n_tokens", "repeats")


def mix_shares(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Target, weight and actual share of each source of each mix, and its most repeats."""
    sizes = stored(sizes)
    used = mixed(sizes, targets).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("n_docs"))
    both = mix_weights(sizes.where("n_tokens > 0"), targets).join(used, ["mix_name", "source"], "left")
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy("mix_name"))
    share = F.round(F.when(total > 0, F.coalesce("tokens", F.lit(0)) / total).otherwise(0.0), 6)
    return both.select(
        "mix_name", "source", "target_share", F.round("weight", 6).alias("weight"), F.round("exponent", 6).alias("exponent"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        share.alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
    )


_TEMPERED = "mix_name string, source string, tokens bigint, source_share double, target_entropy double, exponent double, weight double, entropy double, repeats double"


def _temper(mix: pd.DataFrame) -> pd.DataFrame:
    mix = mix.sort_values("source")
    tokens = mix["tokens"].fillna(0).tolist()
    shares = _shares(tokens)
    wanted = mix["target_share"].clip(lower=0).fillna(0).where(mix["tokens"].fillna(0) > 0, 0.0)
    target = entropy((wanted / wanted.sum()).tolist()) if wanted.sum() else 0.0
    exponent = exponent_for_entropy(shares, target)
    weights = tempered(shares, exponent)
    budget = float(mix["budget"].iloc[0] or 0)
    rows = [(m, s, int(n), p, target, exponent, w, entropy(weights), w * budget / n if n else 0.0) for m, s, n, p, w in zip(mix["mix_name"], mix["source"], tokens, shares, weights)]
    return pd.DataFrame(rows, columns=["mix_name", "source", "tokens", "source_share", "target_entropy", "exponent", "weight", "entropy", "repeats"])


def tempered_weights(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix the source shares tempered to the entropy of its targets, whatever the single targets are."""
    return _wanted(stored(sizes.where("n_tokens > 0").select("source", "n_tokens")), targets).groupBy("mix_name").applyInPandas(_temper, _TEMPERED)
