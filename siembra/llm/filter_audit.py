"""Audit of how filters interact: a histogram of failure masks, from which every order of the filters follows.

Built-in expressions give each text a mask of the filters it fails. A document's position among
equal texts needs the smallest id of each text, which a grouping by text (by its SHA-256, so that
no text is shuffled) supplies. Beyond that nothing depends on the order of the filters: per part
there are 2^5 cells of documents with one mask, and what a filter removes, finds removed already
or loses of the good documents after any others is a sum over cells. So documents are read once,
and the permutations are enumerated from cells, not from documents.

Everything but the join with the smallest ids is combined before it is shuffled; that join
is on (text, id), so a text that a third of all documents share is spread by their ids.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siembra.llm.shared import named, text_of

FILTERS = "ABCDE"
#: Characters that separate words.
_BLANKS = "\t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column, least_words: int = 100, least_distinct: int = 80, most_upper: int = 10) -> list[Column]:
    """Failures of A to D: few words, repeated words, many capitals, symbols of markup or code.

    An empty text has no words and no repetitions: it fails A alone.
    """
    words = F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return [F.size(words) < least_words, F.size(F.array_distinct(words)) * 100 < F.size(words) * least_distinct, upper * 100 > F.length(text) * most_upper, text.rlike("[#$%&*|]")]


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask; bit k of the mask is the failure of filter k.

    A null part and an empty one are the same part, a null text is empty. A document without an id
    is nobody's copy and has no label; rows with one id and one text are no copies of each
    other. Of several labels of an id any 1 counts.
    """
    text = text_of(text_col)
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_failures(F.col("t")))]
    rows = docs.select(named(id_col).alias("i"), F.coalesce(named(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select("i", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("h"), sum(bits[1:], bits[0]).alias("m")).groupBy("i", "part", "h", "m").agg(F.count("*").alias("n"))
    first = rows.groupBy("h").agg(F.min("i").alias("least")).where("least IS NOT NULL").select(F.col("h").alias("fh"), F.col("least").alias("fi"), F.lit(True).alias("is_first"))
    flagged = rows.join(first, (F.col("h") == F.col("fh")) & (F.col("i") == F.col("fi")), "left")
    copy = F.col("i").isNotNull() & F.col("is_first").isNull()
    marks = labels.select(named(id_col).alias("li"), named("quality").alias("q"), named("toxic").alias("x")).where("li IS NOT NULL").groupBy("li").agg(F.max((F.col("q") == 1).cast("int")).alias("good"), F.max((F.col("x") == 1).cast("int")).alias("toxic"))
    flagged = flagged.select("i", "part", "n", (F.col("m") + F.when(copy, 16).otherwise(0)).alias("mask")).join(marks, F.col("i") == F.col("li"), "left")
    return flagged.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))


def audit_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each filter does at each step of every order, per part, from the cells alone.

    A part's cells (32 at most) form one row; its 120 orders of 5 steps come from that row.
    """
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = by_part.select("part", "cells", F.explode(orders).alias("filter_order")).select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit = F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{filters}') - 1)")
    prior = F.expr(f"aggregate(sequence(0, step - 1), 0, (s, k) -> s + if(k = 0, 0, shiftleft(1, locate(substring(filter_order, k, 1), '{filters}') - 1)))")
    steps = steps.withColumns({"bit": bit, "prior": prior})

    def total(measure: str, condition: str) -> Column:
        return F.expr(f"aggregate(cells, 0L, (s, c) -> s + if({condition}, c.{measure}, 0L))")

    here = "c.mask & prior = 0 AND c.mask & bit != 0"
    weight = "CASE bit_count(c.mask) " + " ".join(f"WHEN {k} THEN {_orders(len(filters)) // k}" for k in range(1, len(filters) + 1)) + " END"
    return steps.select(
        "part", "filter_order", "step",
        total("n", "c.mask & (prior | bit) = 0").alias("kept"), total("n", here).alias("removed"), total("n", "c.mask & prior != 0 AND c.mask & bit != 0").alias("redundant"), total("n", "c.mask = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # of the orders of a mask's filters each comes first equally often
        F.expr(f"aggregate(cells, 0L, (s, c) -> s + if(c.mask & bit != 0, c.n * {weight}, 0L))").alias("shapley"),
    )


def _orders(n: int) -> int:
    return 1 if n < 2 else n * _orders(n - 1)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Texts of any length are whole; no documents give no rows. Repeated rows count as often as they
    stand. Other columns, whatever their names, don't matter. See ``failure_cells`` for nulls and ties.
    """
    return audit_orders(failure_cells(docs, labels, id_col, text_col, part_col))
