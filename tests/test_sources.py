import pytest
from pyspark.sql import functions as F

from labelrank.sources import tables, web


def test_csv_tokens_quotes_and_types(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('name,n,x,flag,tm\n"Smith, J",1,1.5,True,NA\n"He said ""hi""",2,,False,BOS\nplain,,-2e3,True,null\n')
    df = tables.read_csv(spark, str(path))
    assert df.dtypes == [("name", "string"), ("n", "double"), ("x", "double"), ("flag", "boolean"), ("tm", "string")]
    assert [tuple(r) for r in df.collect()] == [
        ("Smith, J", 1.0, 1.5, True, None), ('He said "hi"', 2.0, None, False, "BOS"), ("plain", None, -2000.0, True, None)]
    assert tables.csv_columns(spark, str(path)) == ["name", "n", "x", "flag", "tm"]
    typed = tables.read_csv(spark, str(path), "n int, name string")
    assert typed.columns == ["n", "name"] and [r.n for r in typed.collect()] == [1, 2, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_csv(spark, str(path), "name int").collect()
    assert [r.name for r in tables.read_csv(spark, str(path), "name int", strict=False).collect()] == [None] * 3


def test_csv_inference_of_whole_numbers_and_odd_text(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("a,b,c\n1,1d,inf\n2,2,3\n")
    assert tables.read_csv(spark, str(path)).dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")]


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', 0.1), (2, None, None)], "id bigint, t string, x double")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_line_breaks_and_blanks(spark, tmp_path):
    df = spark.createDataFrame([(1, " a\nb, \"c\"\r\nd "), (2, "x")], "id bigint, t string")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,2\n")
    (tmp_path / "2.csv").write_text("b,a\n20,10\n")
    (tmp_path / "3.csv").write_text("a,b\n3,4\n")
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path)).collect())) == [(1, 2), (3, 4), (10, 20)]
    (tmp_path / "4.csv").write_text("a,c\n5,6\n")
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN|CANNOT_RESOLVE|cannot resolve|Cannot resolve"):
        tables.read_csv(spark, str(tmp_path)).collect()


def test_partitioned_table_prunes(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 5 + 2000).alias("season"), "id")
    tables.write_table(df, str(tmp_path / "t"), ["season"])
    plan = spark.read.parquet(str(tmp_path / "t")).where("season between 2001 and 2002")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan


def test_reports_and_params(spark, tmp_path):
    rep = spark.createDataFrame([("m", 0, "0", 0.5), ("m", 1, "0", 0.7), ("n", 0, "accuracy", 1.0)], "model string, fold int, label string, precision double")
    tables.write_reports(rep, str(tmp_path / "r"), ["model", "fold"])
    assert (tmp_path / "r" / "model=m" / "fold=1").is_dir()
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3
    best = spark.createDataFrame([("m", {"k": "3"}, 0.9)], "model string, params map<string,string>, mean_accuracy double")
    tables.write_best_params(best, str(tmp_path / "p"))
    assert tables.read_best_params(spark, str(tmp_path / "p")).collect() == best.collect()


def test_season_keys_and_urls(spark):
    keys = [r.season_key for r in web.season_keys(spark).orderBy("season_key").collect()]
    assert len(keys) == 27 and keys[0] == "1996-97" and keys[3] == "1999-00" and keys[-1] == "2022-23"
    df = spark.createDataFrame([("1999-00",)], "k string").select(web.season_url("https://h.example/a%20b", F.col("k")).alias("u"))
    assert df.first().u == "https://h.example/a%20b?Season=1999-00&SeasonType=Playoffs"
    row = df.select(web.url_param("u", "Season").alias("s"), web.url_param("u", "none").alias("n"), web.season_start(web.url_param("u", "Season")).alias("y")).first()
    assert tuple(row) == ("1999-00", None, 1999)


HEAD = "<table><tr><th>#</th><th> PLAYER</th><th>GP</th><th>PTS</th></tr>"


def pages(spark, *bodies):
    rows = [(f"https://h.example/?Season=1996-97&page={i}", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "url string, html string")


def test_html_rows(spark):
    html = HEAD + (
        "<TR class='x'>\n<td>1</td><td><a href='#'><b>A</b> &amp; B</a></td><td> 3\n</td><td>4.5</td></TR>"
        "<tr><td>2</td><td>O&#39;N&#x00e9;al&nbsp;&lt;x&gt; &amp;lt; &#38;gt;</td><td>7</td></tr></table>"
    )
    out = web.season_stats(pages(spark, html, "<p>nothing here</p>", HEAD + "</table>"), ["PLAYER", "GP", "PTS"])
    assert out.columns == ["season", "player", "gp", "pts"]
    assert sorted(tuple(r) for r in out.collect()) == [
        (1996, "A & B", 3.0, 4.5), (1996, "O'Néal <x> &lt; &gt;", 7.0, None)]


def test_html_other_header_order_and_absent_header(spark):
    swapped = "<table><tr><th>PTS</th><th>PLAYER</th></tr><tr><td>9</td><td>A</td></tr></table>"
    assert [tuple(r) for r in web.season_stats(pages(spark, swapped), ["PLAYER", "PTS"]).collect()] == [(1996, "A", 9.0)]
    with pytest.raises(Exception, match="no column GP"):
        web.season_stats(pages(spark, swapped), ["PLAYER", "GP"]).collect()


def test_html_number_that_is_not_one(spark):
    html = "<table><tr><th>PLAYER</th><th>GP</th></tr><tr><td>A</td><td>-</td></tr></table>"
    assert web.season_stats(pages(spark, html), ["PLAYER", "GP"]).first().gp is None


def test_odd_pages(spark):
    html = (
        "<table><tr><th>PLAYER<th>PTS<tr><td>Don&ccaron;i&cacute;<td>1,234</tr><tr><td>A<br>B &#9999999; &#xD800;<td>7</table>"
        "<table><tr><th>PLAYER</th></tr><tr><td>T</td></tr></table>"
    )
    rows = [tuple(r) for r in web.season_stats(pages(spark, html), ["PLAYER", "PTS"]).select("player", "pts").collect()]
    assert rows == [("Dončić", 1234.0), ("A B � �", 7.0)]
    assert [r.cells for r in web.table_rows(pages(spark, html), table=2).collect()] == [["T"]]


def cells(spark, html, table=1):
    return [r.cells for r in web.table_rows(pages(spark, html), table=table).orderBy("row").collect()]


def test_html_tables_inside_cells(spark):
    html = "<table><tr><th>A<tr><td>x <table><tr><th>in</th></tr><tr><td>1</td></tr></table> y</td></tr><tr><td>z</table><table><tr><th>B<tr><td>b</table>"
    assert cells(spark, html) == [["x in1 y"], ["z"]]
    assert cells(spark, html, 2) == [["1"]] and cells(spark, html, 3) == [["b"]] and cells(spark, html, 4) == [] == cells(spark, html, 0)


def test_html_comments_scripts_and_quoted_tags(spark):
    html = (
        "<!-- <table><tr><td>no</td></tr></table> --><table title='a > b'><script>document.write('</table><tr><td>')</script><style>td > b {}</style>"
        '<tr><th>A</th></tr><tr class="</tr>"><td data="<td>">1<!-- </td> --></td></tr></table>')
    assert cells(spark, html) == [["1"]]


def test_html_spans(spark):
    html = (
        "<table><thead><tr><th>A</th><th colspan=2>B</th></tr></thead><tbody><tr><td rowspan=2>a</td><td>1</td><td>2</td></tr>"
        "<tr><td colspan='2'>3</td></tr><tr><td>b</td><td rowspan=0>4</td><td>5</td></tr><tr><td>c</td><td>6</td></tr></tbody>"
        "<tbody><tr><td colspan=x>d</td><td>7</td></tr></tbody></table>")
    assert cells(spark, html) == [["a", "1", "2"], ["a", "3", "3"], ["b", "4", "5"], ["c", "4", "6"], ["d", "7"]]
    assert web.table_rows(pages(spark, html)).first().header == ["A", "B", "B"]


def test_html_nulls_and_pages_without_tables(spark):
    rows = [("u1", None), ("u2", ""), ("u3", "<p>text</p>"), ("u4", "<tr><th>A<tr><td>1"), (None, "<table><tr><th>A<tr><td>2</table>"), ("u6", "</table></td><td")]
    got = web.table_rows(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted((r.url or "", r.header, r.row, r.cells) for r in got) == [("", ["A"], 1, ["2"]), ("u4", ["A"], 1, ["1"])]
    assert web.table_rows(spark.createDataFrame([], "url string, html string")).count() == 0
