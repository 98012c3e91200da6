"""Product master with the history of names, kept up batch by batch in any order of months.

The store has two tables. ``sums`` holds what every batch added by code, name, kind, category and month; it is only
ever appended to, in folders by batch and year with months in order, so that a batch reads the months it touches and few others. ``intervals``
holds the validity of names: for each code the runs of months with one dominant name, with their months and
the edges of the runs next to them. A batch opens the runs that its months fall in or border on, puts the months' new names
in and closes them again; all other runs are passed on as they are. Version numbers depend on every run of a code and are made when the
master is published.

The name of a month is the one of most quantity, the smallest of equals. Null codes, names and quantities count as empty and 0;
rows without a month are left out. An empty batch is kept as one without months.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siembra.functions.text import normalize_product_name, stable_hash
from siembra.sources.scratch import dropped, written

TOTAL = "decimal(28,4)"
SUMS = f"codigo string, nombre string, tipo string, categoria string, periodo date, qty {TOTAL}, filas bigint"
RUNS = "codigo string, nombre string, meses array<date>, desde date, hasta date, antes date, despues date"

# Shares from which a gate warns and from which it fails.
GATES = {"pct_codigos_con_conflicto": (0.02, 0.05), "pct_filas_sin_codigo": (0.05, 0.10), "pct_nombres_no_mapeados": (0.02, 0.05)}


def condensed(base: DataFrame, *also: str) -> DataFrame:
    """Base rows of one code, spelling, kind, category, month (and ``also``) as one, with their quantity and their number ``filas``.

    Spellings are few and rows are many: what follows normalises each spelling once a month instead of once a row.
    """
    keys = ("codigo_producto", "producto_dashboard", "tipo_producto", "categoria_producto", "periodo", *also)
    rows = base.withColumns({"periodo": F.trunc(F.to_date("periodo"), "MM"), "qty_vendida": _quantity(base)})
    return rows.groupBy(*keys).agg(F.sum("qty_vendida").cast(TOTAL).alias("qty_vendida"), F.sum("filas" if "filas" in base.columns else F.lit(1)).alias("filas"))


def _quantity(base: DataFrame) -> Column:
    """The quantity of a base row, no number as 0; sums of ``condensed`` keep their width."""
    return F.coalesce(F.col("qty_vendida").try_cast(TOTAL if "filas" in base.columns else "decimal(18,4)"), F.lit(0))


def tidy(base: DataFrame, normalise: Callable[[Column], Column] = normalize_product_name) -> DataFrame:
    """The columns the master reads: code, name as given and normalised, kind, category, first day of the month, quantity, and ``filas`` of condensed rows."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return base.select(
        F.trim(text("codigo_producto")).alias("codigo"), text("producto_dashboard").alias("original"), normalise(F.col("producto_dashboard")).alias("nombre"),
        F.col("tipo_producto").cast("string").alias("tipo"), F.col("categoria_producto").cast("string").alias("categoria"),
        F.trunc(F.to_date("periodo"), "MM").alias("periodo"), _quantity(base).alias("qty"), *(["filas"] if "filas" in base.columns else []),
    )


def sums(rows: DataFrame) -> DataFrame:
    """What rows of ``tidy`` add to the store."""
    keys = ("codigo", "nombre", "tipo", "categoria", "periodo")
    return rows.where("periodo is not null").groupBy(*keys).agg(F.sum("qty").cast(TOTAL).alias("qty"), F.sum("filas" if "filas" in rows.columns else F.lit(1)).alias("filas"))


def dominant(added: DataFrame) -> DataFrame:
    """Code, month and the month's name, for rows with a code."""
    by_name = added.where("codigo != ''").groupBy("codigo", "periodo", "nombre").agg(F.sum("qty").alias("qty"))
    best = F.min_by("nombre", F.struct(-F.col("qty"), F.col("nombre")))
    return by_name.groupBy("codigo", "periodo").agg(best.alias("nombre"))


def _closed(months: DataFrame) -> DataFrame:
    """Runs of equal names over (codigo, periodo, nombre), with the edges of the runs beside them in ``months``."""
    w = Window.partitionBy("codigo").orderBy("periodo")
    starts = months.withColumn("__new", (~F.col("nombre").eqNullSafe(F.lag("nombre").over(w))).cast("int"))
    numbered = starts.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy("codigo", "__run").agg(F.first("nombre").alias("nombre"), F.array_sort(F.collect_list("periodo")).alias("meses"), F.min("periodo").alias("desde"), F.max("periodo").alias("hasta"))
    order = Window.partitionBy("codigo").orderBy("__run")
    return runs.withColumns({"antes": F.lag("hasta").over(order), "despues": F.lead("desde").over(order)}).drop("__run")


def absorb(runs: DataFrame, names: DataFrame) -> DataFrame:
    """Runs once the months in ``names`` (codigo, periodo, nombre) have the names given there.

    A run that ends before the code's first changed month stays unless it is the last one to do so, and likewise behind
    the last changed month: what lies beyond those two can't change, nor can their outer edges.
    """
    span = names.groupBy("codigo").agg(F.min("periodo").alias("__lo"), F.max("periodo").alias("__hi"))
    met = runs.join(span, "codigo", "left")
    near = F.coalesce((F.col("despues").isNull() | (F.col("despues") >= F.col("__lo"))) & (F.col("antes").isNull() | (F.col("antes") <= F.col("__hi"))), F.lit(False))
    columns = ("codigo", "nombre", "meses", "desde", "hasta", "antes", "despues")
    kept = met.where(~near).select(*columns)
    opened = met.where(near)
    edges = opened.groupBy("codigo").agg(F.min_by("antes", "desde").alias("__first"), F.max_by("despues", "desde").alias("__last"))
    old = opened.select("codigo", F.explode("meses").alias("periodo"), "nombre").join(names.select("codigo", "periodo"), ["codigo", "periodo"], "left_anti")
    new = _closed(old.unionByName(names.select("codigo", "periodo", "nombre"))).join(edges, "codigo", "left")
    new = new.withColumns({"antes": F.coalesce("antes", "__first"), "despues": F.coalesce("despues", "__last")})
    return kept.unionByName(new.select(*columns))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, without Python workers."""
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


@dataclass
class ProductMaster:
    """The store in a folder that the driver and all executors share.

    A batch has an id and counts once: it is in force when its intervals are written whole, and given again before that it
    replaces its own sums. One writer at a time.
    """

    spark: SparkSession
    folder: str

    def _versions(self) -> list[tuple[int, str]]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/intervals/*/*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path) or []
        parts = [f.getPath().toString().split("/")[-3:-1] for f in found]
        return sorted((int(v.split("=")[1]), b.split("=")[1]) for v, b in parts)

    def runs(self) -> DataFrame:
        done = self._versions()
        if not done:
            return _empty(self.spark, RUNS)
        return self.spark.read.schema(RUNS).parquet("{}/intervals/version={}/batch={}".format(self.folder, *done[-1]))

    def sums(self, *also: str, years: Sequence[int] | None = None) -> DataFrame:
        """What the batches in force (and those of ``also``) added, in all years or in ``years``."""
        ids = sorted({b for _, b in self._versions()} | set(also))
        if not ids or years == []:
            return _empty(self.spark, SUMS)
        rows = self.spark.read.schema(f"{SUMS}, batch string, anio int").parquet(f"{self.folder}/sums").where(F.col("batch").isin(ids))
        return (rows if years is None else rows.where(F.col("anio").isin(years))).drop("batch", "anio")

    def absorb(self, base: DataFrame, batch: str, normalise: Callable[[Column], Column] = normalize_product_name) -> bool:
        """Add a batch of base rows, condensed or not; False if a batch of that id is in force already."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"batch id {batch!r} has to be made of letters, digits, _, . and -")
        done = self._versions()
        if batch in {b for _, b in done}:
            return False
        path = f"{self.folder}/sums/batch={batch}"
        added = sums(tidy(base if "filas" in base.columns else condensed(base), normalise)).withColumn("anio", F.year("periodo")).hint("rebalance", "periodo").sortWithinPartitions("anio", "periodo")
        added.write.mode("overwrite").partitionBy("anio").parquet(path)
        own = self.spark.read.schema(f"{SUMS}, anio int").parquet(path)
        months = [r["periodo"] for r in own.select("periodo").distinct().collect()]
        years = sorted({m.year for m in months})
        every = self.sums(batch, years=years).where(F.col("periodo").isin(months) if months else F.lit(False))
        touched = own.select("codigo", "periodo").distinct()
        names = written(dominant(every.join(touched, ["codigo", "periodo"], "left_semi")), "names")
        absorb(self.runs(), names).write.mode("overwrite").parquet(f"{self.folder}/intervals/version={done[-1][0] + 1 if done else 1}/batch={batch}")
        dropped(names)
        return True

    def published(self) -> DataFrame:
        return published(self.runs(), self.sums())


def _modes(added: DataFrame, *keys: str) -> DataFrame:
    """The most frequent kind and category of rows by key, the smallest of equals."""

    def mode(column: str) -> DataFrame:
        n = added.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.sum("filas").alias("n"))
        return n.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))

    everyone = added.select(*keys).distinct()
    out = everyone.join(mode("tipo"), list(keys), "left").join(mode("categoria"), list(keys), "left")
    return out.select(*keys, F.coalesce("tipo", F.lit("OTRO")).alias("tipo_producto"), F.coalesce("categoria", F.lit("SIN_CATEGORIA")).alias("categoria_producto"))


def numbered(runs: DataFrame) -> DataFrame:
    """Runs with their number among the code's, how many it has, and the sku_id."""
    w = Window.partitionBy("codigo")
    out = runs.withColumns({"version": F.row_number().over(w.orderBy("desde")), "versiones": F.count("*").over(w)})
    sku = F.concat(F.lit("SKU_"), F.col("codigo"))
    return out.withColumn("sku_id", F.when(F.col("versiones") == 1, sku).otherwise(F.concat(sku, F.lit("_V"), F.col("version").cast("string"))))


def published(runs: DataFrame, added: DataFrame) -> DataFrame:
    """The master: one row a run, and one a name of products without a code."""
    coded = numbered(runs).join(_modes(added.where("codigo != ''"), "codigo", "nombre"), ["codigo", "nombre"], "left")
    several = F.col("versiones") > 1
    coded = coded.select(
        "sku_id", F.col("codigo").alias("codigo_producto"), F.col("nombre").alias("producto_canonico"), "tipo_producto", "categoria_producto", F.col("desde").alias("vigente_desde"),
        F.col("hasta").alias("vigente_hasta"), (F.col("version") == F.col("versiones")).alias("activo"), F.when(several, "MEDIA").otherwise("ALTA").alias("calidad_sku"), several.alias("flag_codigo_reciclado"),
    )
    bare = added.where("codigo = '' and nombre != ''")
    spans = bare.groupBy("nombre").agg(F.min("periodo").alias("vigente_desde"), F.max("periodo").alias("vigente_hasta")).join(_modes(bare, "nombre"), "nombre")
    return coded.unionByName(
        spans.select(
            F.concat(F.lit("NO_CODE_"), stable_hash(F.col("nombre"))).alias("sku_id"), F.lit("").alias("codigo_producto"), F.col("nombre").alias("producto_canonico"), "tipo_producto", "categoria_producto",
            "vigente_desde", "vigente_hasta", F.lit(True).alias("activo"), F.lit("BAJA").alias("calidad_sku"), F.lit(False).alias("flag_codigo_reciclado"),
        )
    )


def identified(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``tidy`` with ``sku_id`` and ``calidad_sku``: by code and month, by name without a code, null without both."""
    at = numbered(runs).select("codigo", F.explode("meses").alias("periodo"), F.col("sku_id").alias("__sku"), F.when(F.col("versiones") > 1, "MEDIA").otherwise("ALTA").alias("__grade"))
    by_name = F.when((F.col("codigo") == "") & (F.col("nombre") != ""), F.concat(F.lit("NO_CODE_"), stable_hash(F.col("nombre"))))
    by_code = F.when(F.col("codigo") != "", F.concat(F.lit("SKU_"), F.col("codigo")))
    joined = rows.join(at, ["codigo", "periodo"], "left")
    return joined.withColumns({"sku_id": F.coalesce("__sku", by_name, by_code), "calidad_sku": F.coalesce("__grade", F.lit("BAJA"))}).drop("__sku", "__grade")


def code_conflicts(added: DataFrame, shown: int = 8) -> DataFrame:
    """Codes of several names, the first ``shown`` of them, the span of their months and what to do."""
    names = added.where("codigo != ''").groupBy("codigo", "nombre").agg(F.min("periodo").alias("a"), F.max("periodo").alias("b"))
    ranked = names.withColumn("r", F.row_number().over(Window.partitionBy("codigo").orderBy("nombre")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= shown, F.struct("r", "nombre")))), lambda x: x["nombre"]), " | ")
    out = ranked.groupBy(F.col("codigo").alias("codigo_producto")).agg(F.count("*").alias("nombres_distintos"), F.min("a").alias("periodo_min"), F.max("b").alias("periodo_max"), listed.alias("nombres_detectados"))
    return out.where("nombres_distintos > 1").withColumns({"recomendacion": F.when(F.col("nombres_distintos") <= 2, "REVISAR_MERGE").otherwise("REVISAR_SPLIT"), "estado_resolucion": F.lit("PENDIENTE_MANUAL")})


def name_mapping(rows: DataFrame) -> DataFrame:
    """Every spelling of rows of ``tidy`` with its code's canonical name, the one of most quantity (the smallest of equals)."""
    by_name = rows.where("codigo != ''").groupBy("codigo", "nombre").agg(F.sum("qty").alias("qty"))
    canonical = by_name.groupBy("codigo").agg(F.min_by("nombre", F.struct(-F.col("qty"), F.col("nombre"))).alias("canonico"), (F.count("*") > 1).alias("conflicto"))
    spelled = rows.select("codigo", "original", "nombre", "tipo", "categoria").distinct().join(canonical, "codigo", "left")
    doubt = F.coalesce("conflicto", F.lit(False))
    return spelled.select(
        F.col("codigo").alias("codigo_producto"), F.col("original").alias("nombre_original"), F.col("nombre").alias("nombre_normalizado"), F.coalesce("canonico", "nombre").alias("nombre_canonico"), F.col("tipo").alias("tipo_producto"),
        F.col("categoria").alias("categoria_producto"), F.when(doubt, "MANUAL_REVIEW").otherwise("AUTO_MERGE").alias("decision_sugerida"), doubt.alias("requiere_revision_manual"), doubt.alias("flag_codigo_conflicto"),
    )


def quality_gate(added: DataFrame) -> DataFrame:
    """One row: shares of codes in conflict, of rows without a code and of rows without any identity, and the status."""
    codes = added.where("codigo != ''").groupBy("codigo").agg((F.countDistinct("nombre") > 1).cast("double").alias("c")).agg(F.coalesce(F.avg("c"), F.lit(0.0)).alias("pct_codigos_con_conflicto"))
    rows = lambda use: F.coalesce(F.sum(F.when(use, F.col("filas")).otherwise(0)) / F.sum("filas"), F.lit(0.0))
    bare = F.col("codigo") == ""
    shares = added.agg(rows(bare).alias("pct_filas_sin_codigo"), rows(bare & (F.col("nombre") == "")).alias("pct_nombres_no_mapeados"))
    out = shares.withColumn("pct_codigos_con_conflicto", codes.scalar()).withColumn("pct_match_exacto_maestro", 1 - F.col("pct_nombres_no_mapeados"))
    above = lambda k: F.greatest(*((F.col(c) > limits[k]).cast("int") for c, limits in GATES.items())) == 1
    return out.withColumn("status_calidad", F.when(above(1), "FAIL").when(above(0), "WARNING").otherwise("PASS"))


def require_quality(gate: DataFrame) -> None:
    """Raise if the gate's status is FAIL (the strict mode)."""
    row = gate.first()
    if row["status_calidad"] == "FAIL":
        raise RuntimeError(f"product identities fail the gate: {row.asDict()}")
