"""Silver and gold rules over columns: routing by sign, repairs, levels, bands, validation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siembra.functions.numeric import bucket, safe_ratio
from siembra.operators.order_statistics import quantiles


def route_signs(df: DataFrame, qty: str, value: str) -> DataFrame:
    """Sale and return columns: a negative quantity or value is a return, with its magnitudes; null counts as 0."""
    q, v = F.coalesce(F.col(qty), F.lit(0.0)), F.coalesce(F.col(value), F.lit(0.0))
    back = (q < 0) | (v < 0)
    pick = lambda use, c: F.when(use, F.abs(c)).otherwise(F.lit(0.0))
    return df.withColumns({"cant_venta": pick(~back, q), "total_venta": pick(~back, v), "cant_devolucion": pick(back, q), "total_devolucion": pick(back, v)})


def repair_margin(df: DataFrame, limit: float = 1e13) -> DataFrame:
    """A margin that is null, not finite or ``limit`` and more becomes net less cost, is flagged and has its percentage made anew. Flags that were set stay."""
    net, cost = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("total_neto", "costo_venta"))
    bad = F.col("rentabilidad").isNull() | F.isnan("rentabilidad") | (F.abs("rentabilidad") >= limit)
    fixed = df.withColumns({"rentabilidad": F.when(bad, net - cost).otherwise(F.col("rentabilidad")), "flag_outlier": F.coalesce(F.col("flag_outlier").cast("boolean"), F.lit(False)) | bad if "flag_outlier" in df.columns else bad})
    return fixed.withColumn("prc_rentabilidad", F.when(F.abs(net) > 1e-9, F.col("rentabilidad") / net * 100).otherwise(F.lit(0.0)))


# Levels of the first stage.
DISPATCH = [(95.0, "CUMPLE"), (80.0, "PARCIAL")]
RETURNS = [(15.0, "CRITICA"), (5.0, "ELEVADA")]
MARGINS = [(35.0, "ALTA"), (20.0, "NORMAL"), (0.0, "BAJA")]


def dispatch_class(rate: Column) -> Column:
    return F.when(rate >= DISPATCH[-1][0], bucket(rate, DISPATCH, "BAJO")).when(rate > 0, "BAJO").otherwise("SIN_DESPACHO")


def return_level(rate: Column) -> Column:
    return F.when(rate == 0, "SIN_DEVOLUCION").otherwise(bucket(rate, RETURNS, "NORMAL"))


def margin_level(rate: Column) -> Column:
    return bucket(rate, MARGINS, "PERDIDA")


def alert_sense(margin: Column, returns: Column) -> Column:
    """Sense of an alert from the margin and return ratios."""
    return F.when((margin > 30) & (returns < 10), "POSITIVA").when(returns >= 15, "NEGATIVA").otherwise("MIXTA")


def robust_bound(df: DataFrame, column: str, keys: list[str], factor: float = 3.0, share: float = 0.995, name: str = "bound") -> DataFrame:
    """The largest of the third quartile plus ``factor`` interquartile ranges, the ``share`` quantile and 0, by group."""
    q = quantiles(df, column, [0.25, 0.75, share], keys)
    return q.select(*keys, F.greatest(F.col("q")[1] + factor * (F.col("q")[1] - F.col("q")[0]), F.col("q")[2], F.lit(0.0)).alias(name))


def cap_suspicious(df: DataFrame, keys: list[str], made: str, planned: str, orders: str) -> DataFrame:
    """Extremes of made and planned quantities without an operational signal become their bound; the others stay.

    An extreme of what was made is suspicious without a plan and with less than two orders, one of the plan
    with at most one order. Missing values count as 0.
    """
    m, p, n = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in (made, planned, orders))
    rows = df.withColumns({made: m, planned: p, f"{made}_raw": m, f"{planned}_raw": p})
    bounds = [robust_bound(rows, c, keys, name=f"__{c}") for c in (made, planned)]
    for b in bounds:
        rows = rows.join(b, keys)
    high = {c: F.col(f"{c}_raw") > F.col(f"__{c}") for c in (made, planned)}
    doubt = {made: high[made] & ~((F.col(f"{planned}_raw") > 0) | (n >= 2)), planned: high[planned] & (n <= 1)}
    both = F.when(doubt[made] & doubt[planned], "cap_ambas").when(doubt[made], f"cap_{made}").when(doubt[planned], f"cap_{planned}").otherwise("none")
    flags = {f"extremo_{c}": high[c] for c in high} | {f"sospechoso_{c}": doubt[c] for c in doubt} | {"tratamiento": both}
    out = rows.withColumns(flags).withColumns({c: F.when(F.col(f"sospechoso_{c}"), F.col(f"__{c}")).otherwise(F.col(f"{c}_raw")) for c in (made, planned)})
    return out.drop(*(f"__{c}" for c in (made, planned)))


def lot_bands(df: DataFrame, base: str, factor: str, lot: float = 5.0, kind: str | None = None, lag: str | None = None, spread: str | None = None) -> DataFrame:
    """Recommended quantity and its band in whole lots, min <= recommended <= max; the factor is 0.25 unless given, 0.1 to 1.

    With ``kind``, finished products (PT) add a safety stock, the larger of half of ``spread`` and a tenth of the base, and
    take off a fifth of last month's quantity (``lag``) as a proxy of what is in stock.
    """
    known = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c else F.lit(0.0)
    q = F.ceil(known(base)).cast("double")
    f = F.least(F.greatest(F.coalesce(F.col(factor), F.lit(0.25)), F.lit(0.10)), F.lit(1.0))
    low, high = F.floor(q * (1 - f)).cast("double"), F.ceil(q * (1 + f)).cast("double")
    if kind:
        finished = F.upper(F.trim(F.coalesce(F.col(kind), F.lit("")))) == "PT"
        safety, stock = F.ceil(F.greatest(known(spread) * 0.5, q * 0.1)).cast("double"), F.floor(known(lag) * 0.2).cast("double")
        need = F.when(finished, F.greatest(q + safety - stock, F.lit(0.0))).otherwise(q)
        low = F.when(finished, F.greatest(low + F.floor(safety * 0.7) - F.ceil(stock * 1.1), F.lit(0.0))).otherwise(low)
        high = F.greatest(need, F.when(finished, high + F.ceil(safety * 1.2)).otherwise(high))
    else:
        need, high = q, F.greatest(q, high)
    best = F.ceil(need / lot) * lot
    bands = {"qty_recomendada": best, "qty_min_recomendada": F.least(F.floor(low / lot) * lot, best), "qty_max_recomendada": F.ceil(F.greatest(best, high) / lot) * lot}
    return df.withColumns({name: c.cast("double") for name, c in bands.items()})


def exogenous(panel: DataFrame, calendar: DataFrame, product: DataFrame, source: str) -> DataFrame:
    """Panel with calendar columns by period and product columns by product and period.

    Rows of either table whose ``source_type`` is ``source``, ``ALL``, blank or null hold for it; a value is the mean
    over all that match, and 0 where none does.
    """

    def means(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
        kind = F.upper(F.trim(F.coalesce("source_type", F.lit(""))))
        values = [c for c in df.columns if c not in (*keys, "source_type")]
        return df.where(kind.isin(source, "ALL", "")).groupBy(*keys).agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in values)), values

    by_month, a = means(calendar, ["periodo"])
    by_product, b = means(product, ["product_id", "periodo"])
    out = panel.join(by_month, "periodo", "left").join(by_product, ["product_id", "periodo"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in (*a, *b)})


def next_period(df: DataFrame, key: str, period: str, column: str) -> DataFrame:
    """The value of the following month beside each row (``<column>_t1``); null where that month has no row."""
    ahead = df.select(F.col(key).alias("__k"), F.add_months(period, -1).alias("__p"), F.col(column).alias(f"{column}_t1"))
    return df.join(ahead, (F.col(key) == F.col("__k")) & (F.col(period) == F.col("__p")), "left").drop("__k", "__p")


def input_issues(summary: Mapping[str, Mapping[str, object]], rules: Mapping[str, Mapping[str, float]]) -> list[str]:
    """What a summary of tables (rows, products, target_sum) lacks of the least values in ``rules``."""
    out = []
    for name, least in rules.items():
        stats = summary.get(name)
        if stats is None:
            out.append(f"{name}: missing")
        elif not stats["rows"]:
            out.append(f"{name}: empty")
        else:
            out += [f"{name}: {k} {stats.get(k)} < {v}" for k, v in least.items() if (stats.get(k) or 0) < v]
    return out


def summarise(df: DataFrame, name: str) -> DataFrame:
    """One row: table, rows, products, first and last period, sum of the target."""
    return df.agg(F.lit(name).alias("tabla"), F.count("*").alias("filas"), F.countDistinct("product_id").alias("productos"), F.min("periodo").cast("string").alias("desde"), F.max("periodo").cast("string").alias("hasta"), F.sum(F.coalesce("target_qty", F.lit(0.0)).cast("decimal(18,4)")).cast("double").alias("total"))


def latest_row(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of every key, by ``order``."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__r = 1").drop("__r")


def wape(actual: Column, predicted: Column) -> Column:
    exact = lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    return safe_ratio(exact(F.abs(actual - predicted)), exact(F.abs(actual)))


def segment_errors(rows: DataFrame, keys: list[str], product: str, actual: str, predicted: str) -> DataFrame:
    """By segment: rows, products, WAPE and bias against the actuals (null without any), sMAPE, MAE and RMSE."""
    y, p = F.col(actual), F.col(predicted)
    exact = lambda c: F.sum(c.cast("decimal(18,4)")).cast("double")
    whole = F.nullif(exact(F.abs(y)), F.lit(0.0))
    smape = F.when(F.abs(y) + F.abs(p) > 0, 2 * F.abs(y - p) / (F.abs(y) + F.abs(p))).otherwise(0.0)
    out = {"wape": exact(F.abs(y - p)) / whole, "bias_pct": exact(p - y) / whole * 100, "smape": F.avg(smape), "mae": F.avg(F.abs(y - p)), "rmse": F.sqrt(F.avg((y - p) ** 2))}
    known = rows.where(y.isNotNull() & p.isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("filas"), F.countDistinct(product).alias("productos"), *(F.round(c, 6).alias(name) for name, c in out.items()))
