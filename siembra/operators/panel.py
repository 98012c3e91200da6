"""Monthly panels: grids, lags, rolling and point-in-time features, segments of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siembra.functions.dates import MONTH_NAMES, calendar, in_months, month_index
from siembra.functions.numeric import lookup
from siembra.operators.order_statistics import quantiles
from siembra.sources.scratch import written

LAGS = (1, 2, 3, 6, 12)
ROLLS = (3, 6, 12)


def complete_grid(panel: DataFrame, key: str = "product_id", month: str = "periodo", qty: str = "target_qty", to_global_end: bool = True) -> DataFrame:
    """Every month of every key from its first active month on, zero where nothing was observed.

    The grid ends with the last month of the table, or of the key itself. Keys that were never
    active have no rows. The months come from ``sequence``, so nothing but the panel is joined.
    """
    panel = written(panel, "panel")  # read for its end, its first months and its rows
    active = panel.where(F.col(qty) > 0).groupBy(key).agg(F.min(month).alias("__first"))
    own_end = panel.groupBy(key).agg(F.max(month).alias("__last"))
    if to_global_end:
        last = panel.agg(F.max(month).alias("m"))
        spans = active.withColumn("__last", last.scalar())
    else:
        spans = active.join(own_end, key)
    grid = spans.select(key, F.explode(F.sequence("__first", "__last", F.expr("interval 1 month"))).alias(month))
    joined = grid.join(panel.withColumn("__seen", F.lit(True)), [key, month], "left")
    return joined.withColumn(qty, F.coalesce(qty, F.lit(0.0))).withColumn("monthly_observed_flag", F.coalesce(F.col("__seen"), F.lit(False)).cast("int")).drop("__seen")


def _by(key: str, month: str) -> Window:
    return Window.partitionBy(key).orderBy(month)


def lag_features(panel: DataFrame, key: str = "product_id", month: str = "periodo", qty: str = "target_qty") -> DataFrame:
    """Lags, rolling means and maxima, activity counts and expanding values of the months before each row."""
    w, q = _by(key, month), F.col(qty)
    back = lambda n: w.rowsBetween(-n, -1)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out: dict[str, Column] = {f"lag_{k}": F.lag(q, k).over(w) for k in LAGS}
    out |= {f"rolling_mean_{n}": F.avg(q).over(back(n)) for n in ROLLS}
    out |= {"rolling_max_12": F.max(q).over(back(12)), "rolling_std_3": F.stddev_samp(q).over(back(3))}
    out |= {f"nonzero_{n}": F.coalesce(F.sum((q > 0).cast("int")).over(back(n)), F.lit(0)) for n in (6, 12)}
    out |= {"expanding_mean": F.avg(q).over(past), "expanding_max": F.max(q).over(past), "months_since_first": F.row_number().over(w) - 1}
    return panel.withColumns(out)


def next_month_target(panel: DataFrame, key: str = "product_id", month: str = "periodo", qty: str = "target_qty") -> DataFrame:
    w = _by(key, month)
    return panel.withColumns({"target_next": F.lead(qty).over(w), "next_period": F.lead(month).over(w)})


def point_in_time_profile(panel: DataFrame, key: str = "product_id", month: str = "periodo", qty: str = "target_qty", inactive_months: int = 12, top_share: float = 0.6, most_active_months: int = 4) -> DataFrame:
    """State and seasonality of every row from the months before it alone.

    Quantities by month of the year are running sums over the past, and the active months of a year
    are a number taken when it ends, so one sort by key and month serves all of it and a row holds one number a year;
    the top three months and the median of active months by year are array functions of those.
    """
    w = _by(key, month)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    q = F.coalesce(F.col(qty).cast("double"), F.lit(0.0))
    active = q > 0
    sums = {f"__m{m}": F.coalesce(F.sum(F.when(active & (F.month(month) == m), q)).over(past), F.lit(0.0)) for m in range(1, 13)}
    df = panel.withColumns(sums | {"ultima_actividad": F.last(F.when(active, F.col(month)), ignorenulls=True).over(past)})
    # distinct active months: a key has one row a month, so its rows are distinct already
    year = F.year(month)
    df = df.withColumns({"__so_far": F.coalesce(F.count(F.when(active, year)).over(past), F.lit(0)), "__starts": ~year.eqNullSafe(F.lag(year).over(w))})
    df = df.withColumn("__base", F.last(F.when(F.col("__starts"), F.col("__so_far")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    df = df.withColumn("__ended", F.when(F.col("__starts"), F.nullif(F.col("__so_far") - F.lag("__base").over(w), F.lit(0))))
    df = df.withColumn("__ends", F.collect_list("__ended").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    months = F.array(*(F.struct((-F.col(f"__m{m}")).alias("minus"), F.lit(m).alias("month")) for m in range(1, 13)))
    ranked = F.filter(F.slice(F.sort_array(months), 1, 3), lambda x: x["minus"] < 0)
    df = df.withColumn("__top", ranked).withColumn("__total", sum((F.col(f"__m{m}") for m in range(1, 13)), F.lit(0.0)))
    top = F.aggregate("__top", F.lit(0.0), lambda s, x: s - x["minus"])
    share = F.when(F.col("__total") > 0, top / F.col("__total")).otherwise(F.lit(0.0))
    running = F.nullif(F.col("__so_far") - F.col("__base"), F.lit(0))
    df = df.withColumn("__counts", F.sort_array(F.when(running.isNull(), F.col("__ends")).otherwise(F.array_append("__ends", running))))
    counts = F.col("__counts")
    n = F.size(counts)
    median = F.when(n > 0, (F.element_at(counts, F.greatest(F.floor((n + 1) / 2), F.lit(1)).cast("int")) + F.element_at(counts, F.greatest(F.floor(n / 2) + 1, F.lit(1)).cast("int"))) / 2.0).otherwise(F.lit(0.0))
    seasonal = (n >= 2) & ((share >= top_share) | (median <= most_active_months))
    names = F.transform("__top", lambda x: lookup(x["month"].cast("string"), {str(k): v for k, v in MONTH_NAMES.items()}))
    cutoff = F.add_months(F.col(month), -inactive_months)
    df = df.withColumns({
        "estado_producto": F.when(F.col("ultima_actividad") >= cutoff, "activo").otherwise("inactivo"),
        "es_estacional": seasonal,
        "share_top_3_meses": F.bround(share, 4),
        "meses_estacionales_num": F.array_join(F.transform("__top", lambda x: x["month"].cast("string")), ","),
        "meses_estacionales": F.array_join(names, ", "),
    })
    return df.drop(*(c for c in df.columns if c.startswith("__")))


def feature_matrix(panel: DataFrame, key: str = "product_id", month: str = "periodo", qty: str = "target_qty", **profile: float) -> DataFrame:
    """Calendar, lags and point-in-time profile in one frame; the season flag comes from the profile."""
    df = point_in_time_profile(lag_features(panel, key, month, qty), key, month, qty, **profile).withColumns(calendar(F.col(month)))
    return df.withColumn("seasonal_month_flag", in_months(F.col(month), F.col("meses_estacionales_num")).cast("int"))


def product_summary(panel: DataFrame, key: str = "product_id", month: str = "periodo", qty: str = "target_qty", inactive_months: int = 12, top_share: float = 0.6, most_active_months: int = 4) -> DataFrame:
    """Totals, activity, state and seasonality of every product over its whole history."""
    panel = written(panel, "panel")
    latest = panel.agg(F.max(month).alias("m")).scalar()
    active = panel.where(F.col(qty) > 0)
    totals = panel.groupBy(key).agg(F.sum(F.col(qty).cast("decimal(18,4)")).cast("double").alias("total_qty"), F.count("*").alias("meses_en_serie"), F.min(F.when(F.col(qty) > 0, F.col(month))).alias("primera_actividad"), F.max(F.when(F.col(qty) > 0, F.col(month))).alias("ultima_actividad"), F.count_if(F.col(qty) > 0).alias("meses_con_actividad"))
    by_month = active.groupBy(key, F.month(month).alias("mes")).agg(F.sum(F.col(qty).cast("decimal(18,4)")).alias("q"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("q"), "mes"))
    top = by_month.withColumn("r", rank).where("r <= 3").groupBy(key).agg(F.sum("q").cast("double").alias("top_qty"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "mes"))), lambda x: x["mes"].cast("string")), ",").alias("meses_estacionales_num"))
    by_year = active.groupBy(key, F.year(month).alias("y")).agg(F.countDistinct(F.month(month)).alias("n")).groupBy(key).agg(F.median("n").alias("mediana_meses_activos_por_anio"), F.count("*").alias("anios"))
    joined = totals.join(top, key, "left").join(by_year, key, "left")
    share = F.when(F.col("total_qty") > 0, F.coalesce("top_qty", F.lit(0.0)) / F.col("total_qty")).otherwise(F.lit(0.0))
    cutoff = F.add_months(latest, -(inactive_months - 1))
    return joined.withColumns({
        "estado_producto": F.when(F.col("ultima_actividad") >= cutoff, "activo").otherwise("inactivo"),
        "share_top_3_meses": share,
        "es_estacional": F.coalesce((F.col("anios") >= 2) & ((share >= top_share) | (F.col("mediana_meses_activos_por_anio") <= most_active_months)), F.lit(False)),
    }).drop("top_qty", "anios")


def name_versions(df: DataFrame, code: str, month: str, name: str) -> DataFrame:
    """Validity intervals of a code's names (gaps and islands): sku_id, version, from, to, active.

    The name of a month is its most frequent one, the smallest of equals.
    """
    dominant = df.groupBy(code, month).agg(F.mode(F.nullif(F.col(name), F.lit("")), True).alias("__name")).where("__name is not null")
    w = Window.partitionBy(code).orderBy(month)
    changed = dominant.withColumn("__new", (~F.col("__name").eqNullSafe(F.lag("__name").over(w))).cast("int"))
    versions = changed.withColumn("version", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = versions.groupBy(code, "version").agg(F.first("__name").alias(name), F.min(month).alias("vigente_desde"), F.max(month).alias("vigente_hasta"))
    newest = F.max("version").over(Window.partitionBy(code))
    return out.withColumn("sku_id", F.concat(F.col(code).cast("string"), F.lit("_V"), F.col("version").cast("string"))).withColumn("activo", F.col("version") == newest)


def intermittency(panel: DataFrame, key: str = "product_id", month: str = "periodo", qty: str = "target_qty", few: int = 6) -> DataFrame:
    """Mean months between positive months, share of zero months and whether the history is short."""
    w = _by(key, month)
    placed = panel.withColumn("__place", F.row_number().over(w))
    gaps = placed.where(F.col(qty) > 0).withColumn("__gap", F.col("__place") - F.lag("__place").over(w)).groupBy(key).agg(F.avg("__gap").alias("mean_gap"), F.count("*").alias("positive_months"))
    shape = panel.groupBy(key).agg(F.count("*").alias("months"), F.avg((F.col(qty) <= 0).cast("double")).alias("zero_share"))
    return shape.join(gaps, key, "left").withColumns({"positive_months": F.coalesce("positive_months", F.lit(0)), "low_history": F.coalesce("positive_months", F.lit(0)) < few})


def impute(df: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """Missing values from the month before, else the one after, else the key's median, else 0, with the way taken."""
    w = _by(key, month)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    medians = df.groupBy(key).agg(F.median(value).alias("__median"))
    filled = df.withColumns({"__before": before, "__after": after}).join(medians, key)
    way = F.when(F.col(value).isNotNull(), "observado").when(F.col("__before").isNotNull(), "previo").when(F.col("__after").isNotNull(), "posterior").when(F.col("__median").isNotNull(), "mediana").otherwise("cero")
    return filled.withColumn("imputacion", way).withColumn(value, F.coalesce(value, "__before", "__after", "__median", F.lit(0.0))).drop("__before", "__after", "__median")


def scale_jumps(df: DataFrame, key: str, month: str, value: str, most: float = 8.0) -> DataFrame:
    """Rows whose value is more than ``most`` times the one before, or less than its share."""
    before = F.lag(value).over(_by(key, month))
    jump = F.when(before > 0, F.col(value) / before)
    return df.withColumn("salto", jump).where((F.col("salto") > most) | (F.col("salto") < 1 / most))


def month_difference(later: Column, earlier: Column) -> Column:
    return month_index(later) - month_index(earlier)


def iqr_flags(df: DataFrame, value: str, keys: Sequence[str] = (), times: float = 1.5) -> DataFrame:
    """Quartile bounds by group, whether a value is outside, and the value clipped to them (never below 0)."""
    q = quantiles(df, value, [0.25, 0.75], keys, "__q")
    joined = df.join(q, list(keys), "left") if keys else df.withColumn("__q", q.scalar())
    q1, q3 = F.col("__q")[0], F.col("__q")[1]
    low, high = q1 - (q3 - q1) * times, q3 + (q3 - q1) * times
    return joined.withColumns({"iqr_low": low, "iqr_high": high}).withColumns({"es_outlier": (F.col(value) < F.col("iqr_low")) | (F.col(value) > F.col("iqr_high")), "recortado": F.greatest(F.least(F.col(value), F.col("iqr_high")), F.greatest(F.col("iqr_low"), F.lit(0.0)))}).drop("__q")
