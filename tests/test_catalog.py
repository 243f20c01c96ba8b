"""Every registered query with SQL of its own against DuckDB, and the rest for a stable schema."""

import glob
import os

import duckdb
import pytest

from foliant import catalog, catalog_sheets  # noqa: F401


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_long_sections_equal_sql(spark, tmp_path):
    """A page beyond the length that sections are flagged at, next to a short one and one without an article."""
    words = "<p>" + " ".join(f"Word {i * i}" for i in range(6_000)) + "</p>"
    rows = [(10, f"<html><body><article><h1>Long</h1>{words}</article></body></html>"), (11, "<html><body><article><h1>Short</h1><p>Few.</p></article></body></html>"), (12, "<html><body><p>No article.</p></body></html>")]
    spark.createDataFrame([(i, f"http://x.org/{i}", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = catalog.QUERIES["book_section_rows"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.sql(catalog.ORACLE_SQL["book_section_rows"])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(want.fetchall(), want.columns)
    flagged = catalog.QUERIES["book_sections"](spark, str(tmp_path)).where("warning = 'long'").collect()
    assert [(r["book_id"], r["pos"]) for r in flagged] == [("book-1.epub", 1)]


def test_sections_of_a_page_parsed_once(spark, tmp_path, monkeypatch):
    """All sections of a page come from one parse, and equal those asked for one by one."""
    from pyspark.sql import functions as F

    from foliant.operators import pages

    html = '<body><h1 id="a">One 🦀</h1><p>Words.</p><h1 id="b">Two</h1><pre>x\ty</pre><h1 id="c">Three</h1></body>'
    asked = [(None, None), (None, "b"), ("a", "b"), ("b", None), ("gone", "b"), (None, "gone")]
    rows = spark.createDataFrame([(1, html, asked), (2, None, asked[:1]), (3, html, [])], "id long, html string, asked array<struct<fragment:string,following:string>>")
    kernels = []
    with monkeypatch.context() as m:
        m.setattr(pages, "map_rows", lambda df, kernel, schema: kernels.append(kernel) or df)
        pages.page_sections(rows, "id", "html", "asked")
    parsed = []
    monkeypatch.setattr(pages, "Page", lambda source, page=pages.Page: parsed.append(source) or page(source))
    assert len(list(kernels[0](1, html, [{"fragment": f, "following": n} for f, n in asked]))) == 6 and len(parsed) == 1
    monkeypatch.undo()
    found = pages.page_sections(rows, "id", "html", "asked")
    single = pages.extracted_sections(rows.withColumn("one", F.explode("asked")).select("id", "html", "one.*"), "id", "html", "fragment", "following")
    columns = ["id", "text", "preserved", "elements", "start_node_id", "end_node_id", "error"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, single.select(columns).collect())) and found.count() == 7


def test_small_files_of_much_work_are_spread(spark, sf_dir, tmp_path):
    """Sheets are dealt out by rows; a scan leaves one task to a file of a few bytes a row, however many rows it has."""
    from pyspark.sql import functions as F

    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    (parts.join(spark.range(100).withColumnRenamed("id", "i")).withColumn("p_partkey", F.col("p_partkey") + 1_000 * F.col("i")).drop("i").coalesce(1).write.parquet(f"{tmp_path}/part.parquet"))
    rows = catalog_sheets.sheets(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 20_000
    assert catalog_sheets.sheets(spark, sf_dir).rdd.getNumPartitions() == 1


def test_fragments_found_without_an_exchange(spark, sf_dir):
    """Several fragments in one parse: what ``fragment_node`` finds one by one, ids before names, and no exchange."""
    from pyspark.sql import functions as F

    from foliant.operators import pages

    rows = spark.createDataFrame([(1, '<p name="a">x</p><p id="a">y</p><b name="c"></b><b name="c"></b>'), (2, None), (3, '<script id="a"></script><i id="z"></i>')], "page_id long, html string")
    found = pages.fragment_nodes(rows, ["a", "c", "z", "gone"])
    nodes = pages.page_nodes(rows)
    single = [(r["page_id"], x, r["node_id"]) for x in ("a", "c", "z", "gone") for r in pages.fragment_node(nodes, F.lit(x)).collect()]
    assert sorted(map(tuple, found.collect())) == sorted(single) and len(single) == 3
    astral = rows.where("page_id = 2").withColumn("html", F.lit('<i id="z🦀"></i>'))
    assert pages.fragment_nodes(astral, ["z🦀"]).count() == 1
    plan = catalog.QUERIES["sheet_fragments"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["sheet_blocks", "sheet_fragments", "sheet_sections", "sheet_marks", "sheet_ranges"])
def test_sheet_queries_spread_and_parse_once(spark, sf_dir, tmp_path, name):
    from pyspark.sql import functions as F

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").join(spark.range(100).withColumnRenamed("id", "i"))
    parts.withColumn("p_partkey", F.col("p_partkey") + 1_000 * F.col("i")).drop("i").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RoundRobinPartitioning(5)") == 1 and plan.count("MapInArrow") == 1
