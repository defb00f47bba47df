"""Queries on projects of files, conversations as documents, templates and formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.operators import media, metadata, template
from leafmill.operators import pipeline as p
from leafmill.operators import render as r
from leafmill.sources import includes as i

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# ---- Includes: a tree of suppliers in each nation, with files missing and one that includes its grandparent ----------


def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.concat(F.lit("S"), k, F.lit("\n\\input{./f"), 3 * k + 1, F.lit("}\n\\begin{verbatim}\\input{f0}\\end{verbatim} mid "), k, F.lit("\n\\include{f"), 3 * k + 2, F.lit(".tex}"), F.when(k % 4 == 3, F.concat(F.lit("\\input{f"), F.floor(k / 3).cast("long"), F.lit("}"))).otherwise(""), F.lit("end\n"))
    return spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 7 != 6").select(F.lit(1).alias("project_id"), F.concat(F.lit("f"), k, F.when(k % 2 == 0, ".tex").otherwise(".ltx")).alias("path"), text.alias("text"), k.alias("k"))


EXT = "CASE WHEN {k} % 2 = 0 THEN '.tex' ELSE '.ltx' END"
S = "s AS (SELECT s_suppkey AS k, 'f' || s_suppkey || " + EXT.format(k="s_suppkey") + " AS path FROM supplier WHERE s_suppkey % 7 != 6)"
EDGES = """e AS (SELECT path, k, 1 AS n, 'input' AS command, './f' || (3 * k + 1) AS arg, 3 * k + 1 AS to_k, false AS with_ext FROM s
  UNION ALL SELECT path, k, 2, 'include', 'f' || (3 * k + 2) || '.tex', 3 * k + 2, true FROM s UNION ALL SELECT path, k, 3, 'input', 'f' || k // 3, k // 3, false FROM s WHERE k % 4 = 3)"""
JOINED = "j AS (SELECT e.*, t.path AS target FROM e LEFT JOIN s t ON t.k = e.to_k AND (NOT with_ext OR t.k % 2 = 0))"


@query("a19_scan_includes", f"WITH {S}, {EDGES} SELECT path, n AS nth, command, arg FROM e")
def a19(spark, d):
    from pyspark.sql import Window

    return i.scan_includes(files(spark, d)).select("path", F.row_number().over(Window.partitionBy("path").orderBy("n")).alias("nth"), "command", "arg")


@query("d6_include_join", f"WITH {S}, {EDGES}, {JOINED} SELECT path, command, arg, target FROM j")
def d6(spark, d):
    f = files(spark, d)
    return i.include_join(i.scan_includes(f), f).select("path", "command", "arg", "target")


WALK = f"""WITH RECURSIVE {S}, {EDGES}, {JOINED}, w(root, k, path, inside, ok, warn) AS (
  SELECT k, k, path, CAST([] AS VARCHAR[]), true, CAST(NULL AS VARCHAR) FROM s
  UNION ALL SELECT w.root, j.to_k, j.target, CASE WHEN j.target IS NULL THEN w.inside ELSE list_append(w.inside, j.target) END, j.target IS NOT NULL AND NOT list_contains(w.inside, j.target),
    CASE WHEN j.target IS NULL THEN '\\' || j.command || '{{' || j.arg || '}}: file not found' WHEN list_contains(w.inside, j.target) THEN 'circular \\' || j.command || '{{' || j.arg || '}}' END
  FROM w JOIN j ON j.path = w.path WHERE w.ok)"""


def roots(f):
    return f.select("project_id", F.col("path").alias("root"))


@query("a18_resolve_includes", WALK + " SELECT " + f"'f' || root || {EXT.format(k='root')} AS root, CAST(sum(CASE WHEN ok THEN length('S' || k) + length(' mid ' || k) + length('end') ELSE 0 END) + sum(CASE WHEN ok THEN length('\\begin{{verbatim}}\\input{{f0}}\\end{{verbatim}}') ELSE 0 END) AS BIGINT) AS n_chars, count(*) FILTER (ok) AS n_files FROM w GROUP BY root".replace("{{", "{").replace("}}", "}"))
def a18(spark, d):
    f = files(spark, d)
    texts, _ = i.resolve_includes(f.drop("k"), roots(f))
    return texts.select("root", F.length(F.replace("text", F.lit("\n"), F.lit(""))).cast("long").alias("n_chars"), (F.size(F.split("text", "end\n", -1)) - 1).cast("long").alias("n_files"))


@query("e6_warning_report", WALK + f" SELECT 'f' || root || {EXT.format(k='root')} AS root, warn AS message, count(*) AS n FROM w WHERE warn IS NOT NULL GROUP BY ALL")
def e6(spark, d):
    f = files(spark, d)
    _, warnings = i.resolve_includes(f.drop("k"), roots(f))
    return i.warning_report(warnings).select("root", "message", "n")


# ---- Conversations as documents ------------------------------------------------------------------


def turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), "role", F.coalesce("text", F.lit("")).alias("text"))


TURNS = "(SELECT conv_id AS doc_id, turn AS ord, role, coalesce(text, '') AS text FROM conversations)"


@query("a2_concat_inputs", f"SELECT doc_id, string_agg(text, chr(10) ORDER BY ord, role, text) AS text FROM {TURNS} GROUP BY doc_id")
def a2(spark, d):
    return p.concat_inputs(turns(spark, d).select("doc_id", F.struct("ord", "role", "text").alias("ord"), "text"))


@query("e1_assemble_text", f"SELECT doc_id, string_agg('<b>' || role || '</b>' || text || chr(10), '' ORDER BY ord, role, text) AS text FROM {TURNS} GROUP BY doc_id")
def e1(spark, d):
    piece = F.concat(F.lit("<b>"), "role", F.lit("</b>"), "text", F.lit("\n"))
    return r.assemble_text(turns(spark, d).select("doc_id", F.struct("ord", "role", "text").alias("pos"), piece.alias("piece")))


@query("b11_write_ast_json", f"SELECT doc_id, ord, '{{\"type\":\"paragraph\",\"role\":\"' || role || '\",\"n\":' || length(text) || '}}' AS json FROM {TURNS}".replace("{{", "{").replace("}}", "}"))
def b11(spark, d):
    return p.as_json(turns(spark, d).select("doc_id", "ord", F.lit("paragraph").alias("type"), "role", F.length("text").alias("n")), ["doc_id", "ord"])


@query("b12_render_template", f"""SELECT doc_id, '# $' || doc_id || ' by ' || string_agg(role, ', ' ORDER BY ord, role, text) || CASE WHEN count(*) > 3 THEN ' (long)' ELSE ' (short: ' || count(*) || ')' END || '[]' AS output FROM {TURNS} GROUP BY doc_id""")
def b12(spark, d):
    docs = turns(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "role", "text"))), lambda s: s["role"]).alias("author"), F.struct(F.count("*").alias("n")).alias("meta"), (F.count("*") > 3).alias("long"))
    return template.render_template(docs, "# $$$doc_id$ by $for(author)$$author$$sep$, $endfor$$if(long)$ (long)$else$ (short: $meta.n$)$endif$[$missing$]").select("doc_id", "output")


@query("b13_standalone", f"""SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<title>T&lt;' || doc_id || '</title>' || chr(10) || '<link rel="stylesheet" href="a.css">' || chr(10) || '<link rel="stylesheet" href="b.css">' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) ||
  string_agg('<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' || chr(10), '' ORDER BY ord, role, text) || '</body>' || chr(10) || '</html>' || chr(10) AS output FROM {TURNS} GROUP BY doc_id""")
def b13(spark, d):
    piece = F.concat(F.lit("<p>"), t.escape_html(F.col("text")), F.lit("</p>\n"))
    body = r.assemble_text(turns(spark, d).select("doc_id", F.struct("ord", "role", "text").alias("pos"), piece.alias("piece"))).withColumnRenamed("text", "body")
    docs = body.withColumns({"title": F.concat(F.lit("T<"), "doc_id"), "css": F.array(F.lit("a.css"), F.lit("b.css")), "lang": F.lit("de")})
    return template.standalone(docs, "html", {"lang": "en"}).select("doc_id", "output")


# ---- Formats and resources -------------------------------------------------------------------------


def names(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".md", ".HTML", ".tex", ".xyz", "", ".typ"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("in/d"), "doc_id", ext).alias("path"), F.when(F.col("doc_id") % 11 == 0, "latex").alias("said"))


ROUTE = "CASE WHEN doc_id % 11 = 0 THEN 'latex' ELSE ['markdown', 'html', 'latex', NULL, 'markdown', 'typst'][CAST(doc_id % 6 + 1 AS INTEGER)] END"


@query("a1_d11_format_route", f"SELECT doc_id, {ROUTE} AS format, CASE WHEN {ROUTE} IS NULL THEN 'unknown format: .xyz' END AS error FROM documents")
def d11(spark, d):
    return p.format_route(names(spark, d), "path", "said").select("doc_id", "format", "error")


@query("i5_convert_many", f"SELECT doc_id, CASE WHEN {ROUTE} IS NOT NULL THEN '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>' END AS output, CASE WHEN {ROUTE} IS NULL THEN 'unknown format: .xyz' END AS error FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def i5(spark, d):
    docs = names(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    routed = p.format_route(docs, "path", "said")
    return p.convert_many(routed, lambda x: x.withColumn("output", F.concat(F.lit("<p>"), t.escape_html(F.col("text")), F.lit("</p>")))).select("doc_id", "output", "error")


@query("d7_image_resources", "SELECT DISTINCT l_orderkey AS doc_id, 'img/' || l_partkey || '.png' AS url, p_size FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 5 != 0")
def d7(spark, d):
    images = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("img/"), F.col("l_partkey"), F.lit(".png")).alias("url"))
    found = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 5 != 0").select(F.concat(F.lit("img/"), F.col("p_partkey"), F.lit(".png")).alias("path"), "p_size")
    return media.image_resources(images, found)


@query("e7_keyword_union", "SELECT p_partkey, CASE WHEN lower(p_type) = p_name.string_split(' ')[1] THEN p_name.string_split(' ')[1] || ';' || p_name.string_split(' ')[2] ELSE array_to_string(list_distinct_in_order, ';') END AS keywords FROM (SELECT p_partkey, p_name, p_type, CASE WHEN p_name.string_split(' ')[1] = p_name.string_split(' ')[2] THEN [p_name.string_split(' ')[1], lower(p_type)] ELSE [p_name.string_split(' ')[1], p_name.string_split(' ')[2], lower(p_type)] END AS list_distinct_in_order FROM part)")
def e7(spark, d):
    docs = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.lower("p_type"), F.element_at(F.split("p_name", " "), 1)).alias("b"))
    return metadata.keyword_union(docs, ["a", "b"], "keywords").select("p_partkey", F.array_join("keywords", ";").alias("keywords"))


@query("b15_wrap_and_eol", None)
def b15(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return r.wrap_and_eol(docs, 72)
