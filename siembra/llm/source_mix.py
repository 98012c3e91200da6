"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions.

One slot holds one block of documents of one source. A source of weight w (its integer share of
a period of W slots) gives its j-th block the release ``floor(j * W / w)`` and the deadline
``ceil((j + 1) * W / w)``; in every slot the released block with the earliest deadline goes
(ties: larger weight, then source). The weights add up to W, so every block meets its window
and after any number of slots each source is less than one block from its share, until it runs out.

The schedule repeats every W slots. The pattern of one period (W rows, a parameter) is made
once; the slot of any block is ``(j div w) * W + pattern[source, j mod w]``, so the
documents are never scheduled one after another. A block is ``block_size`` documents of a
source, in the order of a keyed hash. The place of a document in its source is a count by hash
range (combined before the shuffle) plus its place in the range, so a source that holds a third
of all rows is spread over all ranges.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siembra.llm.shared import named

PERIOD = 10_000
BLOCK_SIZE = 16
#: Hash ranges that the documents of a source are counted by.
RANGES = 1024
#: Target weights are shares of documents to this power unless given: 1 keeps the shares, 0 makes them equal.
TEMPERATURE = 0.9
MIX_COLUMNS = ("mix_rank", "mix_block", "mix_release", "mix_deadline", "mix_slot", "in_mix")


def integer_weights(weights: Mapping[object, float], period: int = PERIOD) -> dict[object, int]:
    """Positive integers that add up to ``period``, by largest remainders; each weight gets at least 1.

    Weights that are null, zero or negative get none. Ties go by the source's name.
    """
    positive = {k: v for k, v in weights.items() if v is not None and v > 0}
    if not positive:
        return {}
    if len(positive) > period:
        raise ValueError(f"{len(positive)} sources need a period of as many slots at least")
    total = sum(positive.values())
    exact = {k: v / total * period for k, v in positive.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    by_rest = sorted(exact, key=lambda k: (out[k] - exact[k], str(k)))  # most below its share first
    while (spare := period - sum(out.values())) > 0:
        for k in by_rest[:spare]:
            out[k] += 1
    while (spare := sum(out.values()) - period) > 0:  # tiny weights were raised to 1: the largest give
        for k in [k for k in sorted(out, key=lambda k: (-out[k], str(k))) if out[k] > 1][:spare]:
            out[k] -= 1
    return out


def pfair_pattern(weights: Mapping[object, int]) -> list[tuple[object, int, int, int, int]]:
    """(source, j, release, deadline, slot) of every block of one period, by earliest deadline first."""
    period = sum(weights.values())
    waiting = sorted((j * period // w, -(-(j + 1) * period // w), -w, str(k), k, j) for k, w in weights.items() for j in range(w))
    ready: list[tuple] = []
    out, at = [], 0
    for slot in range(period):
        while at < len(waiting) and waiting[at][0] <= slot:
            release, deadline, minus_w, name, k, j = waiting[at]
            heapq.heappush(ready, (deadline, minus_w, name, j, release, k))
            at += 1
        deadline, _, _, j, release, k = heapq.heappop(ready)
        out.append((k, j, release, deadline, slot))
    return out


def mix_sources(df: DataFrame, weights: Mapping[object, float] | None = None, source_col: str = "source", id_col: str = "doc_id", temperature: float = TEMPERATURE, period: int = PERIOD, block_size: int = BLOCK_SIZE, seed: int = 1) -> DataFrame:
    """``df`` with the place of every row in the mix; one row per input row.

    Added columns (an input column of such a name is replaced): ``mix_rank`` in its source,
    ``mix_block`` (rank div block_size), ``mix_release``, ``mix_deadline`` and ``mix_slot`` in slots, and
    ``in_mix``: whether the slot comes before the first one that a source has no block left for, so that up to there
    all sources hold their targets. It is a mark, not a limit: rows beyond have a slot as well, in which the
    sources that still have blocks go on in the proportions of their weights (the slots of those that ran out
    stay empty). The last block of a source may be smaller. Sources below one slot of the period, which are raised to
    a weight of 1, may run out before. A source without a weight has no slot and isn't in the mix. A null source is a source of
    its own. Ties of the hash order go by id; repeated rows each have a place. Without
    ``weights`` they are the shares of rows to the power ``temperature``. Columns whose name begins with ``__`` are reserved. Sources are as
    many as the period at most; an empty table gives an empty result.
    """
    columns = [c for c in df.columns if c not in MIX_COLUMNS]
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))  # noqa: E731  null is a source like others
    # rows without an id have a place by their row number, or all would share one range
    order = F.coalesce(named(id_col).cast("string"), F.concat(F.lit("="), F.monotonically_increasing_id().cast("string")))
    ranged = df.select(*map(named, columns), key(named(source_col)).alias("__key"), F.xxhash64(F.lit(seed), order).alias("__hash"))
    ranged = ranged.withColumn("__range", F.expr(f"cast(shiftrightunsigned(__hash, {64 - RANGES.bit_length() + 1}) as int)"))
    counts = ranged.groupBy("__key", "__range").agg(F.count("*").alias("__n"))
    sizes = {r["__key"]: r["n"] for r in counts.groupBy("__key").agg(F.sum("__n").alias("n")).orderBy(F.desc("n"), "__key").limit(period + 1).collect()}
    asked = {("" if k is None else f"={k}"): v for k, v in weights.items()} if weights is not None else {k: n**temperature for k, n in sizes.items()}
    shares = integer_weights(asked, period)
    pattern = pfair_pattern(shares)
    total = sum(shares.values())
    first = {(k, j): slot for k, j, _, _, slot in pattern}
    # the first slot that a source can't fill: the one after its last block; raised weights say nothing of a target
    mass = sum(asked[k] for k in shares)
    targets = [k for k in shares if asked[k] * period >= mass]
    blocks = {k: -(-sizes.get(k, 0) // block_size) for k in targets or shares}
    horizon = min((n // shares[k] * total + first[(k, n % shares[k])] for k, n in blocks.items()), default=0)

    spark = df.sparkSession
    # Arrow tables: made in the JVM, without Python workers
    columns_of = lambda rows, names: spark.createDataFrame(pa.table({n: pa.array([r[k] for r in rows], pa.int64() if k else pa.string()) for k, n in enumerate(names)}))
    table = columns_of(pattern, ("__p_key", "__p_j", "__p_release", "__p_deadline", "__p_slot"))
    owned = columns_of(list(shares.items()), ("__w_key", "__w"))

    before = Window.partitionBy("__key").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__key").alias("__o_key"), F.col("__range").alias("__o_range"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__key", "__range").orderBy(F.col("__hash"), named(id_col))
    placed = ranged.withColumn("__place", F.row_number().over(inside) - 1)
    ranked = placed.join(offsets, (F.col("__key") == F.col("__o_key")) & (F.col("__range") == F.col("__o_range"))).withColumn("__rank", F.col("__before") + F.col("__place"))
    # the weights and the pattern have at most ``period`` rows
    blocked = ranked.withColumn("__block", F.expr(f"__rank div {block_size}")).join(F.broadcast(owned), F.col("__key") == F.col("__w_key"), "left")
    timed = blocked.withColumn("__j", F.expr("__block % __w")).join(F.broadcast(table), (F.col("__key") == F.col("__p_key")) & (F.col("__j") == F.col("__p_j")), "left")
    turn = F.expr("__block div __w") * total
    return timed.select(
        *map(named, columns), F.col("__rank").cast("long").alias("mix_rank"), F.col("__block").cast("long").alias("mix_block"),
        (turn + F.col("__p_release")).alias("mix_release"), (turn + F.col("__p_deadline")).alias("mix_deadline"), (turn + F.col("__p_slot")).alias("mix_slot"),
        F.coalesce(turn + F.col("__p_slot") < F.lit(horizon), F.lit(False)).alias("in_mix"),
    )


def mixed(df: DataFrame, **options) -> DataFrame:
    """All rows of sources with a weight, with their own columns, laid out in slot order (range partitions, sorted).

    A source that runs out leaves the order to the others; no row is left out for it.
    """
    placed = mix_sources(df, **options).where("mix_slot is not null")
    return placed.repartitionByRange("mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank").select(*map(named, df.columns))


def places(df: DataFrame, name: str = "mix_place") -> DataFrame:
    """``df`` with the place of every row, from 0 on, in the order in which the table lies: file by file, row by row.

    Spark reads files in any order, so the order of ``mixed`` is taken from the names of the files and the row numbers in
    them; a table that isn't read from files counts by partitions. Only the rows of each file are counted and summed up.
    """
    try:
        rows = df.select(*map(named, df.columns), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        rows = df.select(*map(named, df.columns), F.spark_partition_id().cast("string").alias("__file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__row"))
    before = Window.orderBy(F.length("__file"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("__file").agg(F.count("*").alias("__n")).select(F.col("__file").alias("__named"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # a row a file
    return rows.join(F.broadcast(first), F.col("__file") == F.col("__named")).select(*map(named, df.columns), (F.col("__before") + F.col("__row")).alias(name))
