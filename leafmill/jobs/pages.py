"""Page queries: metadata, blocks, outlines, and HTML made of orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.operators import documents as r
from leafmill.sources import html as h

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")


UN = "replace(replace(replace(replace(replace({s}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&amp;', '&')"


@query("a13_html_metadata", f"SELECT page_id, trim({UN.format(s=chr(39).join(['regexp_extract(html, ', '(?s)<title>(.*?)</title>', ', 1)']))}) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, 0 AS n_keywords FROM pages")
def a13(spark, d):
    return h.html_metadata(pages(spark, d)).select("page_id", "title", "lang", F.size("keywords").alias("n_keywords"))


# The text of a paragraph runs from its tag to the next tag that is none of b, a or br, whatever is left open.
PARA = f"trim(regexp_replace({UN.format(s='regexp_replace(x, ' + chr(39) + '<[^>]*>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '[ \\n\\t]+', ' ', 'g'))"
FIND = "unnest(regexp_extract_all(html, '(?s)<(?:p|h1)>(?:[^<]|</?(?:b|a)\\b[^>]*>|<br>)*'))"


@query("a7_html_blocks", f"""SELECT page_id, CASE WHEN x LIKE '<h1>%' THEN 'heading' ELSE 'paragraph' END AS kind, {PARA} AS text, count(*) AS n
FROM (SELECT page_id, {FIND} AS x FROM (SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>', '') AS html FROM pages)) WHERE {PARA} != '' GROUP BY ALL""")
def a7(spark, d):
    """Headings and paragraphs between the first heading and the footer, with their whole text."""
    p = h.page_arrays(pages(spark, d))
    first = F.array_min(F.transform(F.filter("blocks", lambda b: b["kind"] == "heading"), lambda b: b["pos"]))
    last = F.array_max(F.transform(F.filter("blocks", lambda b: (b["kind"] == "div") & (b["depth"] == 0)), lambda b: b["pos"]))
    prose = p.select("page_id", first.alias("first"), last.alias("last"), F.inline("blocks")).where("kind IN ('heading', 'paragraph') AND pos >= first AND pos < last AND text != ''")
    return prose.where(~F.array_contains("ancestors", "list")).groupBy("page_id", "kind", "text").agg(F.count("*").alias("n"))


LINKS = "(SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>')) AS x FROM pages)"


@query("a8_html_links", f"SELECT page_id, regexp_extract(x, 'href=\"([^\"]*)\"', 1) AS url, {UN.format(s='regexp_extract(x, ' + chr(39) + '>([^<]*)<' + chr(39) + ', 1)')} AS value, count(*) AS n FROM {LINKS} GROUP BY ALL")
def a8(spark, d):
    inlines = h.page_inlines(h.html_blocks(pages(spark, d)))
    return inlines.where("kind = 'link'").groupBy("page_id", "url", "value").agg(F.count("*").alias("n"))


@query("a9_html_unwrap", """SELECT page_id, 0 AS list_depth, 1 AS item_depth, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items, 1 AS divs FROM pages WHERE len(regexp_extract_all(html, '<li>')) > 0""")
def a9(spark, d):
    """Lists of navigation without the section around them, at the depth that is left; only the article stays a section."""
    b = h.html_blocks(pages(spark, d), document=True)
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    found = b.groupBy("page_id").agg(of("list", "depth").alias("list_depth"), of("item", "depth").alias("item_depth"), n("item").alias("items"), n("div").cast("int").alias("divs"))
    return found.where("items > 0")


TITLE = UN.format(s="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")


@query("w4_page_outline", f"""WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>', '') AS html FROM pages),
x AS (SELECT page_id, {FIND} AS x FROM p), y AS (SELECT page_id, {PARA} AS s, x LIKE '<h1>%' AS is_heading FROM x)
SELECT p.page_id, trim({TITLE}) AS title, trim(regexp_replace(regexp_replace(regexp_replace(lower({TITLE}), '[ _]', '-', 'g'), '[^\\p{{L}}\\p{{N}}-]', '', 'g'), '-+', '-', 'g'), '-') AS id,
  (SELECT count(*) FROM y WHERE y.page_id = p.page_id AND s != '' AND NOT is_heading) AS paragraphs FROM p""")
def w4(spark, d):
    """Title, id of the first heading and number of paragraphs of each page: one pass, nothing is shuffled."""
    of = lambda test: F.filter("blocks", test)
    head, last = F.try_element_at(of(lambda b: b["kind"] == "heading"), F.lit(1)), F.array_max(F.transform(of(lambda b: (b["kind"] == "div") & (b["depth"] == 0)), lambda b: b["pos"]))
    p = h.page_arrays(pages(spark, d)).withColumns({"head": head, "last": last}).where("head IS NOT NULL")
    prose = F.size(of(lambda b: (b["kind"] == "paragraph") & (F.size(b["ancestors"]) <= 1) & (b["text"] != "") & (b["pos"] > F.col("head.pos")) & (b["pos"] < F.col("last"))))
    return p.select("page_id", F.col("head.text").alias("title"), t.slugify(F.col("head.text")).alias("id"), prose.cast("long").alias("paragraphs"))


# Pages by the rule that makes them: a list of links, an advertisement, an article of a heading and paragraphs, a footer.
PAGE = f"""WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<script.*?</script>', '') AS html FROM pages),
nav AS (SELECT page_id, n, {UN.format(s="regexp_extract(x, 'href=.([^>]*).>', 1)")} AS url, {UN.format(s="regexp_extract(x, '>([^<]*)</a>', 1)")} AS said FROM (SELECT page_id, generate_subscripts(a, 1) AS n, unnest(a) AS x FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS a FROM p))),
art AS (SELECT page_id, n, x, max(CASE WHEN contains(x, '<b>') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY n) AS bold FROM (SELECT page_id, generate_subscripts(a, 1) AS n, unnest(a) AS x FROM (SELECT page_id, string_split(regexp_extract(html, '(?s)</h1>(.*)</article>', 1), '<p>')[2:] AS a FROM p))),
para AS (SELECT page_id, n, bold, {PARA} AS s FROM art),
f AS (SELECT page_id, {PARA.replace('(x,', "(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1),")} AS foot, {PARA.replace('(x,', "(regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1),")} AS ad, {PARA.replace('(x,', "(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1),")} AS head FROM p)"""
NLS = "chr(10)"


@query("w4_pages_to_plain", f"""{PAGE} SELECT page_id, (SELECT string_agg('- ' || said || ' (' || url || ')' || {NLS}, '' ORDER BY n) FROM nav WHERE nav.page_id = f.page_id) || {NLS} || ad || {NLS} || {NLS} || head || {NLS} || repeat('=', strlen(head)) || {NLS} || {NLS} ||
  coalesce((SELECT string_agg(s || {NLS} || {NLS}, '' ORDER BY n) FROM para WHERE para.page_id = f.page_id AND s != ''), '') || foot || {NLS} AS text FROM f""")
def w4_plain(spark, d):
    """Whole pages as plain text."""
    return r.render_documents(h.page_documents(pages(spark, d)), None, "plain").withColumnRenamed("doc_id", "page_id")


@query("w4_pages_to_markdown", f"""{PAGE} SELECT page_id, (SELECT string_agg('- [' || said || '](' || url || ')' || {NLS}, '' ORDER BY n) FROM nav WHERE nav.page_id = f.page_id) || {NLS} || ad || {NLS} || {NLS} || ':::' || {NLS} || '# ' || head || {NLS} ||
  coalesce((SELECT string_agg({NLS} || CASE WHEN bold = 1 THEN '**' || s || '**' ELSE s END || {NLS}, '' ORDER BY n) FROM para WHERE para.page_id = f.page_id AND s != ''), '') || ':::' || {NLS} || {NLS} ||
  CASE WHEN (SELECT max(bold) FROM para WHERE para.page_id = f.page_id) = 1 THEN '**' || foot || '**' ELSE foot END || {NLS} AS text FROM f""")
def w4_markdown(spark, d):
    """Whole pages as Markdown; an element for bold text that a page leaves open goes on to its end."""
    return r.render_documents(h.page_documents(pages(spark, d)), None, "markdown").withColumnRenamed("doc_id", "page_id")


# ---- HTML made of orders ----------------------------------------------------------------------------


def lines(spark, d):
    """One row for each order and line number; dealt out by order, so that what groups them by it needs no other shuffle."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").repartition("l_orderkey")
    return li.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag")).alias("x")).select("doc_id", "n", "x.*")


LINES = "(SELECT doc_id, n, m[1] AS l_partkey, m[2] AS l_suppkey, m[3] AS l_returnflag FROM (SELECT l_orderkey AS doc_id, l_linenumber AS n, min((l_partkey, l_suppkey, l_returnflag)) AS m FROM lineitem GROUP BY ALL))"


def order_tables(spark, d):
    """A table for each order: a head, a row for each line (with spans), a foot."""
    td = lambda c, extra="": F.concat(F.lit(f"<td{extra}>"), c, F.lit("</td>"))
    span = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit('<td colspan="'), F.col("l_partkey") % 4 + 1, F.lit('"> &lt;<b>'), F.col("l_partkey"), F.lit("</b>&gt; </td>"))).otherwise(td(F.col("l_partkey").cast("string")))
    tr = F.concat(F.lit("<tr>"), span, td(F.col("l_suppkey").cast("string"), ' style="text-align: right"'), F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", tr.alias("tr")))), lambda s: s["tr"]), "")
    whole = F.concat(F.lit("<table><thead><tr><th>Part</th><th>Supplier</th></tr><tr><th>no</th></tr></thead><tbody>"), body, F.lit("</tbody><tfoot><tr><td rowspan='2'>end</td></tr></tfoot></table>"))
    return lines(spark, d).groupBy("doc_id").agg(whole.alias("html"))


CELLS = f"""(SELECT doc_id, 'tbody' AS section, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS row, 0 AS col, CASE WHEN l_partkey % 3 = 0 THEN '<' || l_partkey || '>' ELSE CAST(l_partkey AS VARCHAR) END AS text,
    CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey % 4 + 1 AS INTEGER) ELSE 1 END AS colspan, 1 AS rowspan, CAST(NULL AS VARCHAR) AS align FROM {LINES}
  UNION ALL SELECT doc_id, 'tbody', CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER), 1, CAST(l_suppkey AS VARCHAR), 1, 1, 'right' FROM {LINES}
  UNION ALL SELECT DISTINCT l_orderkey, 'thead', 0, 0, 'Part', 1, 1, NULL FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'thead', 0, 1, 'Supplier', 1, 1, NULL FROM lineitem
  UNION ALL SELECT DISTINCT l_orderkey, 'tfoot', 0, 0, 'end', 1, 2, NULL FROM lineitem)"""


@query("a11_html_table_cells", f"SELECT * FROM {CELLS}")
def a11(spark, d):
    return h.table_cells(order_tables(spark, d))


@query("e4_table_shape", f"SELECT doc_id, 2 AS n_cols, CAST(count(*) AS INTEGER) AS n_rows FROM {LINES} GROUP BY doc_id")
def e4(spark, d):
    from leafmill.operators.render import table_shape

    return table_shape(h.table_cells(order_tables(spark, d)))


@query("b2_render_html_table", f"""SELECT doc_id, '<table>' || chr(10) || '<thead>' || chr(10) || '<tr><th><p>Part</p>' || chr(10) || '</th><th><p>Supplier</p>' || chr(10) || '</th></tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) ||
  string_agg('<tr><td' || CASE WHEN l_partkey % 3 = 0 AND l_partkey % 4 != 0 THEN ' colspan="' || (l_partkey % 4 + 1) || '"' ELSE '' END || '><p>' || CASE WHEN l_partkey % 3 = 0 THEN '&lt;' || l_partkey || '&gt;' ELSE CAST(l_partkey AS VARCHAR) END || '</p>' || chr(10) || '</td>' ||
    '<td style="text-align: right"><p>' || l_suppkey || '</p>' || chr(10) || '</td></tr>' || chr(10), '' ORDER BY n) || '</tbody>' || chr(10) || '<tfoot>' || chr(10) || '<tr><td rowspan="2"><p>end</p>' || chr(10) || '</td></tr>' || chr(10) || '</tfoot>' || chr(10) || '</table>' || chr(10) AS html FROM {LINES} GROUP BY doc_id""")
def b2(spark, d):
    from leafmill.operators.render import html_table

    return html_table(h.table_cells(order_tables(spark, d)))


@query("b7_plaintext_table", f"""WITH c AS (SELECT *, greatest(3, max(strlen(text)) OVER (PARTITION BY doc_id, col)) AS w FROM {CELLS}), k AS (SELECT doc_id, max(col) + 1 AS n_cols FROM c GROUP BY doc_id),
full_rows AS (SELECT doc_id, section, row, string_agg(' ' || text || repeat(' ', w - strlen(text)) || ' |', '' ORDER BY col) AS s, count(*) AS n FROM c GROUP BY doc_id, section, row),
pad AS (SELECT f.doc_id, f.section, f.row, '|' || f.s || coalesce((SELECT string_agg(repeat(' ', wd + 2) || '|', '' ORDER BY col) FROM (SELECT DISTINCT doc_id, col, w AS wd FROM c) z WHERE z.doc_id = f.doc_id AND z.col >= f.n), '') AS s FROM full_rows f),
rule AS (SELECT doc_id, '+' || string_agg(repeat('-', w + 2) || '+', '' ORDER BY col) AS s FROM (SELECT DISTINCT doc_id, col, w FROM c) GROUP BY doc_id)
SELECT doc_id, r.s || chr(10) || string_agg(CASE section WHEN 'tfoot' THEN r.s || chr(10) ELSE '' END || pad.s || chr(10) || CASE section WHEN 'thead' THEN r.s || chr(10) ELSE '' END, '' ORDER BY CASE section WHEN 'thead' THEN 0 WHEN 'tbody' THEN 1 ELSE 2 END, row) || r.s || chr(10) AS text
FROM pad JOIN rule r USING (doc_id) GROUP BY doc_id, r.s""")
def b7(spark, d):
    from leafmill.operators.render import plaintext_table

    return plaintext_table(h.table_cells(order_tables(spark, d)))


@query("b4_markdown_table", f"""SELECT doc_id, '| Part | Supplier |' || chr(10) || '| --- | ---: |' || chr(10) || string_agg('| ' || CASE WHEN l_partkey % 3 = 0 THEN '<' || l_partkey || '>' ELSE CAST(l_partkey AS VARCHAR) END || ' | ' || l_suppkey || ' |' || chr(10), '' ORDER BY n) || '| end |' || chr(10) AS markdown FROM {LINES} GROUP BY doc_id""")
def b4(spark, d):
    from leafmill.operators.render import markdown_table

    return markdown_table(h.table_cells(order_tables(spark, d)))


@query("a6_pipe_table_cells", f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS row, 0 AS col, CAST(l_partkey AS VARCHAR) AS text, 'left' AS align FROM {LINES}
  UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER), 1, 'a|' || l_suppkey, 'center' FROM {LINES}
  UNION ALL SELECT DISTINCT l_orderkey, 0, 0, 'Part', 'left' FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 0, 1, 'Supplier', 'center' FROM lineitem""")
def a6(spark, d):
    from leafmill.sources.markdown import pipe_table_cells

    row = F.concat(F.lit("| "), F.col("l_partkey"), F.lit(" | a\\|"), F.col("l_suppkey"), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("r")))), lambda s: s["r"]), "\n")
    return pipe_table_cells(lines(spark, d).groupBy("doc_id").agg(F.concat(F.lit("| Part | Supplier |\n|:---|:-:|\n"), body).alias("text")))


@query("a12_html_definition_items", f"""WITH l AS {LINES}, g AS (SELECT doc_id, n, l_partkey, l_suppkey, l_partkey % 3 = 0 AS is_term, (SELECT count(*) FROM l x WHERE x.doc_id = l.doc_id AND x.n <= l.n AND x.l_partkey % 3 = 0) AS item FROM l)
SELECT doc_id, item, coalesce(max(CASE WHEN is_term THEN 'P' || l_partkey END), '') AS term, coalesce(string_agg(CASE WHEN NOT is_term THEN 's ' || l_suppkey END, ';' ORDER BY n), '') AS definitions FROM g GROUP BY doc_id, item""")
def a12(spark, d):
    part = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("<dt>P"), F.col("l_partkey"), F.lit("</dt>"))).otherwise(F.concat(F.lit("<dd><i>s</i> "), F.col("l_suppkey"), F.lit("</dd>")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("r")))), lambda s: s["r"]), "\n")
    lists = lines(spark, d).groupBy("doc_id").agg(F.concat(F.lit("<dl>"), body, F.lit("</dl>")).alias("html"))
    return h.definition_items(lists).select("doc_id", F.col("item").cast("long").alias("item"), "term", F.array_join("definitions", ";").alias("definitions"))


@query("a10_html_code_language", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'py' END AS language FROM part")
def a10(spark, d):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("x language-"), F.lower("p_type"))).when(k == 1, "py").when(k == 2, "highlight-source").otherwise("a b")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", h.code_language(F.split(said, " ")).alias("language"))
