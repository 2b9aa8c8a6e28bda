from __future__ import annotations

from pyspark.sql import functions as F

from labelrank.operators import evaluate
from labelrank.queries.base import query, table
from labelrank.queries.evaluating import BEST_PARAMS, _PRED, _report_sql, candidates, flat_params, predictions, rounded_report
from labelrank.queries.ranking import TOPK_HITS, season_topk_hits
from labelrank.session import scratch_path
from labelrank.sources import tables, web

_YEARS = "y as (select cast(year(o_orderdate) as int) yr, count(*) orders from orders group by 1)"
_KEY = "printf('%d-%02d', yr, (yr + 1) % 100)"
BASE = "https://stats.example.org/players/late"


@query(f"""with {_YEARS}
select yr, orders, {_KEY} season_key, '{BASE}?Season=' || {_KEY} || '&SeasonType=Playoffs' url, yr as start, {_KEY} param from y""")
def season_keys(spark, sf_dir):
    """Season keys and page addresses of the years with orders, and both read back from the address."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count(F.lit(1)).alias("orders"))
    return (
        years.withColumn("season_key", web.season_key("yr"))
        .withColumn("url", web.season_url(BASE, F.col("season_key")))
        .withColumn("param", web.url_param("url", "Season"))
        .withColumn("start", web.season_start("param"))
    )


@query(r"""select page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') page,
       nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') ref from pages""")
def url_param(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", web.url_param("url", "page").alias("page"), web.url_param("url", "ref").alias("ref"))


def supplier_pages(spark, sf_dir):
    """Web pages with one table each: 50 supplier keys of one nation per page, one nation per season.

    Cells carry inner tags, character references and line breaks; suppliers in debt lack the last cell.
    """
    def cell(*parts):
        return F.concat(F.lit("<td class='n'>"), *parts, F.lit("</td>\n"))

    name = cell(F.lit(" <a href='/p?a=1&amp;b=2'><b>"), F.col("s_name"), F.lit("</b></a> &amp; Sons &#8364;&lt;1 "))
    row = F.concat(
        F.lit("<tr>"), cell(F.lit("#")), cell(F.col("s_suppkey").cast("string")), name,
        cell(F.lit("\n  "), F.col("s_acctbal").cast("string")),
        F.when(F.col("s_acctbal") < 0, F.lit("")).otherwise(cell(F.col("s_nationkey").cast("string"))),
        F.lit("</tr>"),
    )
    head = "<html><table><thead><tr><th>#</th><th>GP</th><th> PLAYER </th><th>PTS</th><th>TOV</th></tr></thead>"
    page = F.floor(F.col("s_suppkey") / 50).cast("bigint")
    season = web.season_key(F.lit(1996) + F.col("s_nationkey"))
    return (
        table(spark, sf_dir, "supplier")
        .groupBy("s_nationkey", page.alias("page"))
        .agg(F.concat_ws("\n", F.array_sort(F.collect_list(row))).alias("rows"))
        .select(
            F.concat(web.season_url(BASE, season), F.lit("&page="), F.col("page").cast("string")).alias("url"),
            F.concat(F.lit(head), F.col("rows"), F.lit("</table></html>")).alias("html"),
        )
    )


@query("""select 1996 + s_nationkey season, s_name || ' & Sons €<1' player, cast(s_suppkey as double) gp, s_acctbal pts,
       case when s_acctbal >= 0 then cast(s_nationkey as double) end tov from supplier""")
def html_table_rows(spark, sf_dir):
    pages = supplier_pages(spark, sf_dir)
    return web.season_stats(pages, ["PLAYER", "GP", "PTS", "TOV"])


@query("select page_id from pages where not coalesce(html ilike '%<tr%', false)")
def html_pages_without_table(spark, sf_dir):
    """Pages that give no table row."""
    rows = web.table_rows(table(spark, sf_dir, "pages"))
    found = rows.select("url").distinct()
    return table(spark, sf_dir, "pages").join(found, "url", "left_anti").select("page_id")


@query("""select 1996 + s_nationkey season, s_name || 'č �' player, s_suppkey * 1000.0::double gp, s_acctbal pts from supplier""")
def html_odd_rows(spark, sf_dir):
    """Two tables on a page, omitted end tags, line breaks, named and impossible references, grouped digits."""
    row = F.concat(
        F.lit("<tr><td>"), F.col("s_name"), F.lit("&ccaron;<br>&#9999999;<td>"), F.format_number(F.col("s_suppkey") * 1000, 0),
        F.lit("<td>"), F.col("s_acctbal").cast("string"))
    page = F.floor(F.col("s_suppkey") / 50).cast("bigint")
    url = F.concat(web.season_url(BASE, web.season_key(F.lit(1996) + F.col("s_nationkey"))), F.lit("&page="), F.col("page").cast("string"))
    pages = table(spark, sf_dir, "supplier").groupBy("s_nationkey", page.alias("page")).agg(
        F.concat_ws("\n", F.array_sort(F.collect_list(row))).alias("rows")
    ).select(url.alias("url"), F.concat(
        F.lit("<table><tr><th>PLAYER<th>GP<th>PTS"), F.col("rows"), F.lit("</table><table><tr><th>PTS</th></tr><tr><td>9</td></tr></table>")).alias("html"))
    return web.season_stats(pages, ["PLAYER", "GP", "PTS"])


@query("""select 1996 + s_nationkey season, s_name || ' of ' || s_nationkey player, s_nationkey::double gp, s_acctbal pts from supplier""")
def html_nested_rows(spark, sf_dir):
    """Tables inside cells, a cell that spans all rows of its page, tags in comments, scripts and attributes."""
    row = F.concat(
        F.lit("<td title='</td></table> > '>"), F.col("s_name"), F.lit("<table><tr><td> of <!-- </table> --></td><td>"), F.col("s_nationkey"),
        F.lit("</td></tr></table></td><td colspan=1>"), F.col("s_acctbal").cast("string"), F.lit("<script>'</table>'</script></td></tr>"))
    page = F.floor(F.col("s_suppkey") / 50).cast("bigint")
    url = F.concat(web.season_url(BASE, web.season_key(F.lit(1996) + F.col("s_nationkey"))), F.lit("&page="), F.col("page").cast("string"))
    pages = table(spark, sf_dir, "supplier").groupBy("s_nationkey", page.alias("page")).agg(
        F.concat_ws("<tr>", F.collect_list(row)).alias("rows"), F.count(F.lit(1)).alias("n")
    ).select(url.alias("url"), F.concat(
        F.lit("<!-- <table> --><table><tr><th>GP</th><th>PLAYER</th><th>PTS</th></tr><tr><td rowspan="), F.col("n"), F.lit(">"),
        F.col("s_nationkey"), F.lit("</td>"), F.col("rows"), F.lit("</table>")).alias("html"))
    return web.season_stats(pages, ["PLAYER", "GP", "PTS"])


_CUSTOMER = """select c_custkey, c_name, c_nationkey, c_acctbal,
       case when c_custkey % 11 = 0 then null else c_mktsegment end c_mktsegment from customer"""


def _customer_csv(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    gaps = F.when(F.col("c_custkey") % 11 == 0, "NA").otherwise(F.col("c_mktsegment"))
    tables.write_csv(table(spark, sf_dir, "customer").withColumn("c_mktsegment", gaps), path)
    return path


@query(_CUSTOMER)
def csv_roundtrip(spark, sf_dir):
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return tables.read_csv(spark, _customer_csv(spark, sf_dir), schema)


@query(_CUSTOMER.replace("c_nationkey,", "cast(c_nationkey as bigint) c_nationkey,", 1))
def csv_inferred(spark, sf_dir):
    return tables.read_csv(spark, _customer_csv(spark, sf_dir))


@query("select cast(cid as int) as position, name as column_name from pragma_table_info('customer')")
def header_only(spark, sf_dir):
    """Names in the header of a CSV file, whose rows are not read."""
    names = tables.csv_columns(spark, _customer_csv(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(names)), "position int, column_name string")


@query("select doc_id, nullif(text, '') as text from documents")
def csv_text_roundtrip(spark, sf_dir):
    """Whole texts, line breaks and quotes included."""
    path = scratch_path(spark, "documents-csv")
    tables.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return tables.read_csv(spark, path, "doc_id bigint, text string", tokens=("",))


@query(BEST_PARAMS)
def json_params(spark, sf_dir):
    path = scratch_path(spark, "best-params")
    tables.write_best_params(evaluate.best_params(candidates(spark, sf_dir)), path)
    return flat_params(tables.read_best_params(spark, path))


@query(f"with {_PRED}, {_report_sql('model, fold', 1.0)}")
def report_sink(spark, sf_dir):
    """Class reports written to one folder per model and fold, and read back."""
    path = scratch_path(spark, "reports")
    report = evaluate.class_report(predictions(spark, sf_dir), by=["model", "fold"], zero_division=1.0)
    tables.write_reports(report, path, ["model", "fold"])
    schema = "label string, precision double, recall double, f1_score double, support double, model string, fold int"
    return rounded_report(spark.read.schema(schema).option("header", True).csv(path)).select(*report.columns)


@query(TOPK_HITS)
def ranked_sink(spark, sf_dir):
    path = scratch_path(spark, "ranked")
    tables.write_ranked(season_topk_hits(spark, sf_dir), path)
    return spark.read.parquet(path)
