from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import types as T

from siembra.sources import io


def test_report_header(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Empresa;;\nDesde: 1/2/2024;;\nCENTRO_COSTO;Producto;Total\nA;x;1\nB;;2\nTotal;;3\n")
    got = io.read_report(spark, str(tmp_path / "r.csv"), "centro_costo").collect()
    assert [tuple(r) for r in got] == [("A", "x", "1"), ("B", None, "2")]
    with pytest.raises(ValueError, match="no header"):
        io.read_report(spark, str(tmp_path / "r.csv"), "otra")


def test_csv_and_optional(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Año;Valor\nñ;1\nz;x\n".encode("latin1"))
    got = io.read_csv(spark, str(tmp_path / "a.csv"), "a string, v int").collect()
    assert [tuple(r) for r in got] == [("ñ", 1)]
    assert io.read_optional(spark, str(tmp_path / "none.csv"), T.StructType([T.StructField("a", T.IntegerType())])).count() == 0


def test_headers(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Año / Mes", "cantidad", "CANTIDAD "])
    assert io.rename_headers(df, {"ano_mes": "periodo"}).columns == ["periodo", "cantidad"]


def test_json_in_json(spark):
    inner = json.dumps({"k [x]": " a ", "b": ""})
    df = spark.createDataFrame([(1, inner), (2, json.dumps(inner)), (3, '{"b": "1"}')], "id int, data string")
    assert [tuple(r) for r in io.explode_json(df, "data", ["k [x]", "b"], "k [x]").orderBy("id").collect()] == [(1, "a", None), (2, "a", None)]


def test_loads(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "p"), (2, "q")], "v int, pipeline_id string")
    assert io.overwrite(df, path)
    assert not io.overwrite(df.limit(0), path)
    assert spark.read.parquet(path).count() == 2
    io.replace_pipeline(df, path + "p")
    io.replace_pipeline(spark.createDataFrame([(9, "q")], df.schema), path + "p")
    assert sorted(tuple(r) for r in spark.read.parquet(path + "p").collect()) == [(1, "p"), (9, "q")]
    new = io.insert_absent(spark.createDataFrame([(1, "p"), (None, "n"), (3, "r"), (3, "r")], df.schema), spark.createDataFrame([(1, "x"), (None, "y")], df.schema), ["v"])
    assert [tuple(r) for r in new.collect()] == [(3, "r")]
    io.dual_write(df, path + "d")
    assert spark.read.option("header", True).csv(path + "d.csv").count() == 2
    io.log_run(spark, path + "log", rows=2)
    assert json.loads(spark.read.text(path + "log").first()[0]) == {"rows": 2}


def test_paged_service(spark):
    rows = [{"id": k, "name": f"n{k}"} for k in range(23)]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            body = json.dumps(rows[(q["page"] - 1) * q["page_size"] : q["page"] * q["page_size"]]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(io.PagedSource)
    df = spark.read.format("paged").schema("id long, name string").option("url", f"http://127.0.0.1:{server.server_port}/").option("page_size", 5).option("partitions", 2).load()
    assert sorted(r["id"] for r in df.collect()) == list(range(23))
    server.shutdown()
