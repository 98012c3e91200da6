"""How well association rules hold: in later baskets, and under resampling, each from one count of pairs.

Counts are conditional sums over the pairs of a basket's items; baskets of the same items are added up before they are taken apart into pairs. Splits are columns of it; a bootstrap resample is a weight of
each basket, a Poisson number of mean 1 drawn by a hash of basket and resample, so all resamples are columns of it too
and come out the same whatever the partitions. A basket holds at most the top items, so its list and its pairs are bounded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siembra.operators.mining import baskets
from siembra.sources.scratch import written

SPLITS = ("train", "val", "test")
#: Weights of the consensus score: lift, confidence in training and in the test baskets, split stability. Fixed values.
CONSENSUS = {"lift": 0.30, "confidence": 0.25, "conf_test": 0.25, "estabilidad_split": 0.20}


def _counted(pairs: DataFrame, basket: str, item: str, weights: dict[str, Column]) -> DataFrame:
    """Directed pairs (antecedent, consequent) with n_ab, n_a, n_b and n of each weight of the baskets."""
    own = [c for c in pairs.columns if c != item]  # what belongs to the basket: its key, and its part if it has one
    whole = pairs.groupBy(*own).agg(F.array_sort(F.collect_set(item)).alias("items"))
    alike = written(whole.groupBy("items").agg(*(F.sum(w).alias(f"w_{k}") for k, w in weights.items())), "weights")
    added = [f"w_{k}" for k in weights]
    total = alike.agg(*(F.coalesce(F.sum(f"w_{k}"), F.lit(0)).alias(f"n_{k}") for k in weights))
    single = alike.select(F.explode("items").alias("i"), *added).groupBy("i").agg(*(F.sum(f"w_{k}").alias(f"s_{k}") for k in weights))
    a = alike.select(F.explode("items").alias("antecedent"), "items", *added)
    both = a.select("antecedent", F.explode("items").alias("consequent"), *added).where("antecedent != consequent").groupBy("antecedent", "consequent").agg(*(F.sum(f"w_{k}").alias(f"ab_{k}") for k in weights))
    side = lambda name, p: single.select(F.col("i").alias(name), *(F.col(f"s_{k}").alias(f"{p}_{k}") for k in weights))
    out = both.join(side("antecedent", "a"), "antecedent").join(side("consequent", "b"), "consequent")
    return out.crossJoin(F.broadcast(total))  # one row of totals


def _measures(k: str) -> tuple[Column, Column, Column]:
    """Support, confidence and lift; 0 where nothing is below the line."""
    part = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    ab, a, b, n = (F.col(f"{p}_{k}").cast("double") for p in ("ab", "a", "b", "n"))
    return part(ab, n), part(ab, a), part(ab * n, a * b)


def consensus(df: DataFrame, basket: str, item: str, split: str, min_support: float = 0.02, min_confidence: float = 0.25, least_val: float = 0.1, least_test: float = 0.1, least_support: float = 0.005, top: int = 120, top_items: int = 120) -> DataFrame:
    """Rules of the training baskets that also hold in the validation and test baskets, by their consensus score.

    ``split`` names the part (train, val, test) of a row's basket. A rule needs its realised confidence in both later parts
    and its realised support in one of them. The score weighs ranks among the rules left (average
    rank by its share) and in how many later parts the rule would be found again. Of equal scores the first
    by name; without rules there are no rows.
    """
    pairs = baskets(df, basket, item, top_items).join(df.select(basket, split).distinct(), basket)
    counted = _counted(pairs, basket, item, {s: (F.col(split) == s).cast("int") for s in SPLITS})
    support, confidence, lift = _measures("train")
    out = {"support": support, "confidence": confidence, "lift": lift}
    for s in SPLITS[1:]:
        sup, conf, _ = _measures(s)
        out |= {f"support_{s}": sup, f"conf_{s}": conf}
    rules = counted.select("antecedent", "consequent", *(c.alias(name) for name, c in out.items()))
    again = [((F.col(f"support_{s}") >= min_support) & (F.col(f"conf_{s}") >= min_confidence)).cast("double") for s in SPLITS[1:]]
    rules = rules.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)).withColumn("estabilidad_split", sum(again, F.lit(0.0)) / 2)
    rules = rules.where((F.col("conf_val") >= least_val) & (F.col("conf_test") >= least_test) & (F.greatest("support_val", "support_test") >= least_support))
    every = Window.partitionBy(F.lit(0))  # at most top_items squared rules

    def place(c: str) -> Column:
        value = F.round(c, 9)
        ties = Window.partitionBy(F.lit(0), value)
        return (F.rank().over(every.orderBy(value)) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(every)

    score = sum((w * (F.col(c) if c == "estabilidad_split" else place(c)) for c, w in CONSENSUS.items()), F.lit(0.0))
    return rules.withColumn("score_consenso", F.round(score, 9)).orderBy(F.desc("score_consenso"), "antecedent", "consequent").limit(top)


def poisson_weight(key: Column, resample: int, seed: int = 42) -> Column:
    """A Poisson number of mean 1 (at most 8) from a hash of the key."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(resample), key), 11) / float(1 << 53)
    steps, mass = [], 0.0
    for k in range(8):
        mass += math.exp(-1) / math.factorial(k)
        steps.append((u >= mass).cast("int"))
    return sum(steps[1:], steps[0])


def _holds(k: str, min_support: float, min_confidence: float) -> Column:
    support, confidence, _ = _measures(k)
    return (support >= min_support) & (confidence >= min_confidence) & (F.col(f"ab_{k}") > 0)


def bootstrap(pairs: DataFrame, basket: str, item: str, resamples: int = 30, min_support: float = 0.02, min_confidence: float = 0.25, seed: int = 42) -> DataFrame:
    """Rules of all baskets or of any resample, each with (en_base, estabilidad): whether all baskets have it, and the share of resamples that do."""
    names = [f"r{k}" for k in range(resamples)]
    counted = _counted(pairs, basket, item, {"base": F.lit(1)} | {name: poisson_weight(F.col(basket), k, seed) for k, name in enumerate(names)})
    found = counted.select("antecedent", "consequent", _holds("base", min_support, min_confidence).alias("en_base"), F.array(*(_holds(n, min_support, min_confidence) for n in names)).alias("en_muestras"))
    hits = F.size(F.filter("en_muestras", lambda x: x))
    return found.withColumn("estabilidad", hits / resamples).where(F.col("en_base") | (hits > 0))


def jaccard_by_resample(rules: DataFrame, resamples: int = 30) -> DataFrame:
    """(muestra, jaccard): likeness of each resample's rules to those of all baskets; 0 if neither has any."""
    each = rules.select("en_base", F.posexplode("en_muestras").alias("muestra", "hat"))
    g = each.groupBy("muestra").agg(F.count_if(F.col("en_base") & F.col("hat")).alias("i"), F.count_if(F.col("en_base") | F.col("hat")).alias("u"))
    return g.select("muestra", F.when(F.col("u") > 0, F.col("i") / F.col("u")).otherwise(F.lit(0.0)).alias("jaccard"))


__all__: Sequence[str] = ["bootstrap", "consensus", "jaccard_by_resample", "poisson_weight"]
