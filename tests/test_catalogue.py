"""Cleaned catalogue and sales, canonical products and the monthly base on rows worked out by hand."""

from __future__ import annotations

from datetime import date

from siembra.operators import catalogue as C

ITEMS = "item string, description string, ean13 string, ean14 string, um string, price string"
SALES = "marca string, familia string, producto string, anio string, mes string, recuento_cliente string, cantidad string, ventas string"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def sold(spark, rows):
    return spark.createDataFrame(rows, SALES)


def test_catalogue_rows(spark):
    rows = [
        ("pt: Salsas : Ají (12)", "AJI ROJO", "786-1234567890", None, "u", "1.5"),
        ("Otros:Sal 345", " none ", "123", None, None, "x"),
        ("PP:Base", "producto terminado", None, "1", "kg", "nan"),
        (" nan ", "fuera", None, None, None, None),
        (None, "fuera", None, None, None, None),
    ]
    got = {r.item: r for r in C.clean_catalogue(items(spark, rows)).collect()}
    assert len(got) == 3
    a, b, c = got["pt: Salsas : Ají (12)"], got["Otros:Sal 345"], got["PP:Base"]
    assert (a.codigo_producto, a.tipo_producto, a.item_tail, a.producto_dashboard, a.ean13, a.flag_ean13_valido, a.price) == ("0012", "PT", "Ají (12)", "AJI ROJO", "7861234567890", True, 1.5)
    assert (b.codigo_producto, b.tipo_producto, b.description, b.flag_desc_generica, b.producto_dashboard, b.price) == ("0345", "OTRO", "", True, "Sal 345", 0.0)
    assert (c.codigo_producto, c.producto_dashboard, c.flag_ean13_valido, c.price) == ("", "Base", False, 0.0)
    own = C.clean_catalogue(items(spark, [("PT:a", "La Casa", None, None, None, None)]), (*C.GENERIC, "LA CASA")).first()
    assert own.producto_dashboard == "a"
    assert C.clean_catalogue(items(spark, [])).count() == 0


def test_monthly_sales(spark):
    rows = [("M", "F", "Sal (7)", "2024", "Setiembre", "2", "3", "1.25"), ("M", "F", "Sal (7)", "2024.0", "septiembre", "1", "x", None), ("M", "F", "Sal (7)", "2024", "SEPTIEMBRE ", None, "4", "2")]
    rows += [("M", "F", "Sal", "2024", "trece", "1", "1", "1"), ("M", "F", "nan", "2024", "enero", "1", "1", "1"), (None, "nan", "Sal 77", "2024", "enero", "1", "inf", "1")]
    got = {(r.producto, r.periodo): (r.marca, r.codigo_producto, r.recuento_cliente, r.cantidad, r.ventas) for r in C.clean_monthly_sales(sold(spark, rows)).collect()}
    assert got["Sal 77", date(2024, 1, 1)] == ("", "", 1.0, 0.0, 1.0)
    assert got["Sal (7)", date(2024, 9, 1)] == ("M", "0007", 3.0, 7.0, 3.25) and len(got) == 2
    assert C.clean_monthly_sales(sold(spark, [])).count() == 0


def test_canonical_products_and_base(spark):
    cat = C.clean_catalogue(items(spark, [
        ("PT:Sal fina (1)", "SAL", "7860000000001", None, None, None), ("PT:Sal gruesa (1)", "", "7860000000001", None, None, None),
        ("PP:Mezcla (2)", "MEZCLA", None, None, None, None), ("PT:Ajo (3)", "AJO", "7860000000003", None, None, None), ("PT:Ajo b (4)", "AJO", "7860000000003", None, None, None),
    ]))
    row = lambda product, year, month, qty="1": ("M", " fam ", product, year, month, "1", qty, "10")
    months = ["enero", "febrero", "marzo", "abril", "mayo", "junio"]
    ven = C.clean_monthly_sales(sold(spark, [
        *(row("Sal (1)", "2024", m) for m in months), row("Sal. (1)", "2024", "enero", "5"), row("Mezcla (2)", "2023", "diciembre"), row("Ajo (3)", "2024", "mayo"), row("Ajo x (4)", "2023", "noviembre"),
        row("Ají", "2024", "junio"), row("ajo", "2024", "junio"),
    ]))
    dim = {r.codigo_producto: r for r in C.canonical_products(cat, ven).collect()}
    assert (dim["0001"].item_canonico, dim["0001"].flag_conflicto_ean13, dim["0001"].estado_match) == ("PT:Sal fina (1)", True, "exacto")
    assert dim["0002"].tipo_producto == "PP" and not dim["0003"].flag_conflicto_ean13
    base = C.forecasting_base(ven, C.canonical_products(cat, ven)).collect()
    at = {(r.codigo_producto, r.periodo): r for r in base}
    january = at["0001", date(2024, 1, 1)]
    assert (january.qty_vendida, january.ventas_valor, january.clientes, january.producto_dashboard, january.estado_producto, january.categoria_producto) == (6.0, 20.0, 2.0, "SAL", "ACTIVO", "FAM")
    assert at["0002", date(2023, 12, 1)].estado_producto == "INACTIVO" and at["0002", date(2023, 12, 1)].tipo_producto == "OTRO"
    # 0003 and 0004 are one product by their EAN: sold in two months of the year, last in May
    assert at["0003", date(2024, 5, 1)].estado_producto == at["0004", date(2023, 11, 1)].estado_producto == "ESTACIONAL"
    # "ajo" has no code and the name of a finished product: it goes; "Ají" stays
    assert [(r.producto_dashboard, r.tipo_producto) for r in base if r.codigo_producto == ""] == [("Ají", "OTRO")]
    none = C.clean_monthly_sales(sold(spark, []))
    assert C.forecasting_base(none, C.canonical_products(cat, none)).count() == 0
