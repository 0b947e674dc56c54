"""Sources, versioned tables and whole ingests."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import ingest
from corpusloom.sources import files, paged, tables

PROSE = "Plain prose with many different words that say something about rain, rivers and the wide grey sea. "


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text(PROSE)
    (tmp_path / "in/sub/b.MD").write_text("# Title\n" + PROSE + "Another sentence makes it longer.")
    (tmp_path / "in/c.html").write_text(f"<html><body><nav>menu</nav><p>{PROSE} More of it here, quite enough.</p><!-- no --></body></html>")
    (tmp_path / "in/blank.txt").write_text("  \n")
    (tmp_path / "in/x.exe").write_bytes(b"\x00")
    return tmp_path


def test_discovery(spark, folder):
    found = files.discover(spark, [str(folder / "in")], set()).collect()
    assert {r["file_name"] for r in found} == {"a.txt", "b.MD", "c.html", "blank.txt"}
    assert files.discover(spark, [str(folder / "in")], set(), most_bytes=5).count() == 1


def test_scans(spark, folder):
    assert {r["path"].rsplit("/", 1)[1] for r in files.texts(spark, [str(folder / "in")]).collect()} == {"a.txt", "b.MD"}
    page = files.html_pages(spark, [str(folder / "in")]).first()
    assert page["text"].startswith("Plain prose") and "menu" not in page["text"] and "no" not in page["text"].split()


def test_parsers_fall_back(spark, folder):
    def broken(data):
        raise ValueError("no")

    read = files.with_content(spark, [str(folder / "in")])
    found = {r["path"].rsplit("/", 1)[1]: r for r in files.parsed(read, [broken, lambda b: b.decode("ascii").strip()]).collect()}
    assert found["a.txt"]["parser"] == 1 and found["a.txt"]["error"] == "ValueError: no" and found["blank.txt"]["text"] is None


def test_ingest_twice_adds_nothing(spark, folder):
    run = lambda: ingest.ingest(spark, [str(folder / "in")], str(folder / "chunks"), str(folder / "manifest"))
    first = run()
    assert first["files"] == 3 and first["chunks"] >= 3 and run() == first
    (folder / "in/d.txt").write_text("Something entirely new is written here about mountains, snow, valleys and slow warm winds in spring.")
    assert run()["files"] == 4


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.read_version(spark, root, "n int").count() == 0
    assert [tables.write_version(spark.range(k).select(F.col("id").cast("int").alias("n")), root) for k in (2, 5)] == [1, 2]
    assert tables.read_version(spark, root, "n int").count() == 5 and tables.read_version(spark, root, "n int", 1).count() == 2
    tables.clear(spark, root)
    assert tables.versions(spark, root) == []


def test_golden_items(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('// c\n# d\n\n{"id": "a", "stratum": "single", "expected_quantities": [{"value": 1.5, "unit": "km"}]}\n')
    row = files.golden_items(spark, str(tmp_path / "g.jsonl")).first()
    assert row["id"] == "a" and row["answerable"] and row["expected_quantities"][0]["unit"] == "km"
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="not JSON in"):
        files.golden_items(spark, str(tmp_path / "bad.jsonl")).collect()


def test_paged_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rsplit("/", 1)[1])
            body = {"data": [{"id": f"n{page}", "attributes": {"title": f"T{page}", "body": {"value": "<p>x</p>"}}}], "links": {"next": {"href": f"http://127.0.0.1:{port}/{page + 1}"}} if page < 3 else {}}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    port = server.server_port
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        from corpusloom.shipping import ship

        ship(spark)
        spark.dataSource.register(paged.PagedJson)
        nodes = spark.read.format("paged_json").option("urls", f"http://127.0.0.1:{port}/1").load()
        found = files.node_columns(nodes, F.col("node")).collect()
    finally:
        server.shutdown()
    assert sorted((r["uuid"], r["title"], r["text"]) for r in found) == [("n1", "T1", "x"), ("n2", "T2", "x"), ("n3", "T3", "x")]


def test_an_ingest_keeps_formulas_and_nested_pages_whole(spark, tmp_path):
    from corpusloom.operators.chunking import safe_windows
    from corpusloom.plans.ingest import chunk_documents

    prose = "".join(f"Sentence {k} speaks of item{k} and of thing{7 * k} near place{3 * k}. " for k in range(30))
    formula = "$$ " + " + ".join(f"x_{k}^2" for k in range(60)) + " = y $$"
    docs = spark.createDataFrame([("a", "h", prose + formula + "\n\n" + prose.upper()), ("b", "h2", None)], "source string, file_hash string, text string")
    pieces = safe_windows(docs, "text", 600, 50).orderBy("idx").collect()
    assert pieces[0].asDict().keys() == {"source", "file_hash", "idx", "chunk"} and {r.source for r in pieces} == {"a"}
    assert sum(formula in r.chunk for r in pieces) == 1 and max(len(r.chunk) for r in pieces if formula not in r.chunk) <= 600
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) as source", "sha2(text, 256) as file_hash", "text")
    chunks = chunk_documents(given, 600, 50).select("chunk_id", "source", "idx", "chunk").collect()
    assert len(chunks) > 100 and max(len(r.chunk) for r in chunks if "$" not in r.chunk and "|" not in r.chunk) <= 600
    (tmp_path / "p.html").write_text("<div class='cookie-bar'><div>inner</div> still the bar</div><p>Body <b>text</b></p><nav>menu<div>x</div></nav><p>End")
    page = files.html_pages(spark, [str(tmp_path)]).first()
    assert "Body text" in " ".join(page.text.split()) and "End" in page.text and "bar" not in page.text and "menu" not in page.text
