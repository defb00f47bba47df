"""Documents rendered in each format: customers are documents, orders their blocks, line items inlines and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.jobs.pages import LINES, lines
from leafmill.operators import documents as r

QUERIES: dict = {}
ORACLES: dict = {}

KINDS = ["paragraph", "heading", "code", "math", "blockquote", "list", "rule", "paragraph"]
INLINES = ["text", "emphasis", "strong", "code", "link", "math", "footnote_ref", "strikethrough"]


def corpus(spark, d):
    k = F.col("o_orderkey")
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    top = orders.select(
        F.col("o_custkey").alias("doc_id"), (k * 100).alias("pos"), none("long").alias("parent"), F.lit(0).alias("depth"), pick(KINDS, k).alias("kind"), (k % 7 % 4 + 1).cast("int").alias("level"),
        F.when(k % 3 == 0, F.concat(F.lit("h_"), k)).alias("ident"), F.when(k % 5 == 0, "py").alias("language"), F.concat(F.lit("x < "), k, F.lit(" _y_")).alias("text"), (k % 16 == 5).alias("ordered"), (k % 4).cast("int").alias("start"), none("int").alias("index"), none("boolean").alias("checked"),
    )
    li = lines(spark, d).join(orders.select(F.col("o_orderkey").alias("o"), "o_custkey"), F.col("doc_id") == F.col("o")).withColumn("k", F.col("o") * 100)
    o, n = F.col("o"), F.col("n")
    common = [none("int").alias("level"), none("string").alias("ident"), none("string").alias("language"), none("string").alias("text")]
    place = F.row_number().over(r_window()) - 1
    items = li.where(o % 8 == 5).select(F.col("o_custkey").alias("doc_id"), (F.col("k") + 2 * n + 1).alias("pos"), F.col("k").alias("parent"), F.lit(1).alias("depth"), F.lit("item").alias("kind"), *common, (o % 16 == 5).alias("ordered"), (o % 4).cast("int").alias("start"), place.alias("index"), F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("checked"))
    rest = [none("boolean").alias("ordered"), none("int").alias("start"), none("int").alias("index"), none("boolean").alias("checked")]
    inner = li.where(o % 8 == 5).select(F.col("o_custkey").alias("doc_id"), (F.col("k") + 2 * n + 2).alias("pos"), (F.col("k") + 2 * n + 1).alias("parent"), F.lit(2).alias("depth"), F.lit("paragraph").alias("kind"), *common, *rest)
    quoted = li.where(o % 8 == 4).select(F.col("o_custkey").alias("doc_id"), (F.col("k") + 2 * n + 1).alias("pos"), F.col("k").alias("parent"), F.lit(1).alias("depth"), F.lit("paragraph").alias("kind"), *common, *rest)
    blocks = top.unionByName(items).unionByName(inner).unionByName(quoted)
    kind = pick(INLINES, F.col("l_partkey"))
    pos = F.when(o % 8 == 5, F.col("k") + 2 * n + 2).when(o % 8 == 4, F.col("k") + 2 * n + 1).otherwise(F.col("k"))
    value = F.when(kind == "footnote_ref", F.concat(F.lit("n"), "l_suppkey")).otherwise(F.concat(F.lit("w"), "l_suppkey", F.lit("_<")))
    inlines = li.where((o % 8).isin(0, 1, 4, 5, 7)).select(F.col("o_custkey").alias("doc_id"), pos.alias("pos"), n.alias("ipos"), kind.alias("kind"), value.alias("value"), F.concat(F.lit("u"), "l_partkey").alias("url"), F.concat(F.lit("N"), "l_suppkey").alias("note"))
    return blocks, inlines


def r_window():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("n")


V = "'w' || s || '_<'"
INLINE_SQL = {
    "html": "CASE i WHEN 0 THEN 'w' || s || '_&lt;' WHEN 1 THEN '<em>w' || s || '_&lt;</em>' WHEN 2 THEN '<strong>w' || s || '_&lt;</strong>' WHEN 3 THEN '<code>w' || s || '_&lt;</code>' WHEN 4 THEN '<a href=\"u' || p || '\">w' || s || '_&lt;</a>' WHEN 5 THEN '<span class=\"math math-inline\">w' || s || '_&lt;</span>' WHEN 6 THEN '<sup class=\"footnote-ref\"><a href=\"#fn-n' || s || '\">[n' || s || ']</a></sup>' ELSE '<del>w' || s || '_&lt;</del>' END",
    "markdown": "CASE i WHEN 0 THEN {v} WHEN 1 THEN '*' || {v} || '*' WHEN 2 THEN '**' || {v} || '**' WHEN 3 THEN '`' || {v} || '`' WHEN 4 THEN '[' || {v} || '](u' || p || ')' WHEN 5 THEN '$' || {v} || '$' WHEN 6 THEN '[^n' || s || ']' ELSE '~~' || {v} || '~~' END",
    "plain": "CASE i WHEN 4 THEN {v} || ' (u' || p || ')' WHEN 6 THEN '[^n' || s || ']' ELSE {v} END",
    "latex": "CASE i WHEN 0 THEN 'w' || s || '\\_<' WHEN 1 THEN '\\emph{{w' || s || '\\_<}}' WHEN 2 THEN '\\textbf{{w' || s || '\\_<}}' WHEN 3 THEN '\\texttt{{w' || s || '\\_<}}' WHEN 4 THEN '\\href{{u' || p || '}}{{w' || s || '\\_<}}' WHEN 5 THEN '$' || {v} || '$' WHEN 6 THEN '\\footnotemark[n' || s || ']' ELSE '\\sout{{w' || s || '\\_<}}' END",
    "typst": "CASE i WHEN 0 THEN 'w' || s || '\\_\\<' WHEN 1 THEN '_w' || s || '\\_\\<_' WHEN 2 THEN '*w' || s || '\\_\\<*' WHEN 3 THEN '`' || {v} || '`' WHEN 4 THEN '#link(\"u' || p || '\")[w' || s || '\\_\\<]' WHEN 5 THEN '$' || {v} || '$' WHEN 6 THEN '#footnote[N' || s || ']' ELSE '#strike[w' || s || '\\_\\<]' END",
}
INLINE_SQL["myst"] = INLINE_SQL["markdown"]
NL = "chr(10)"
MD_ITEM = "CASE WHEN k % 16 = 5 THEN (k % 4 + rn - 1) || '. ' ELSE '- ' END || CASE f WHEN 'A' THEN '[x] ' WHEN 'R' THEN '[ ] ' ELSE '' END || x || chr(10)"
#: By format: a list item, a quoted paragraph, what is between quoted paragraphs, and the block by k % 8 from content c, quotes q, items t.
BLOCK_SQL = {
    "html": ("CASE f WHEN 'A' THEN '<li class=\"task-list-item\"><input type=\"checkbox\" checked disabled> ' WHEN 'R' THEN '<li class=\"task-list-item\"><input type=\"checkbox\" disabled> ' ELSE '<li>' END || '<p>' || x || '</p>' || chr(10) || '</li>' || chr(10)", "'<p>' || x || '</p>' || chr(10)", "''",
        "CASE k % 8 WHEN 1 THEN '<h' || lv || CASE WHEN k % 3 = 0 THEN ' id=\"h_' || k || '\"' ELSE '' END || '>' || c || '</h' || lv || '>' || chr(10) WHEN 2 THEN '<pre><code' || CASE WHEN k % 5 = 0 THEN ' class=\"language-py\"' ELSE '' END || '>x &lt; ' || k || ' _y_</code></pre>' || chr(10) WHEN 3 THEN '<div class=\"math math-display\"' || CASE WHEN k % 3 = 0 THEN ' id=\"h_' || k || '\"' ELSE '' END || '>x &lt; ' || k || ' _y_</div>' || chr(10) WHEN 4 THEN '<blockquote>' || chr(10) || q || '</blockquote>' || chr(10) WHEN 5 THEN CASE WHEN k % 16 = 5 THEN CASE WHEN k % 4 != 1 THEN '<ol start=\"' || k % 4 || '\">' ELSE '<ol>' END ELSE '<ul>' END || chr(10) || t || CASE WHEN k % 16 = 5 THEN '</ol>' ELSE '</ul>' END || chr(10) WHEN 6 THEN '<hr>' || chr(10) ELSE '<p>' || c || '</p>' || chr(10) END", "''"),
    "markdown": (MD_ITEM, "'> ' || x || chr(10)", "'>' || chr(10)",
        "CASE k % 8 WHEN 1 THEN repeat('#', lv) || ' ' || c || CASE WHEN k % 3 = 0 THEN ' {#h_' || k || '}' ELSE '' END || chr(10) WHEN 2 THEN '```' || CASE WHEN k % 5 = 0 THEN 'py' ELSE '' END || chr(10) || 'x < ' || k || ' _y_' || chr(10) || '```' || chr(10) WHEN 3 THEN '$$' || chr(10) || 'x < ' || k || ' _y_' || chr(10) || '$$' || chr(10) || CASE WHEN k % 3 = 0 THEN '<!-- label: h_' || k || ' -->' || chr(10) ELSE '' END WHEN 4 THEN CASE WHEN q = '' THEN '>' || chr(10) ELSE q END WHEN 5 THEN t WHEN 6 THEN '---' || chr(10) ELSE c || chr(10) END", "chr(10)"),
    "plain": (MD_ITEM, "'> ' || x || chr(10)", "'>' || chr(10)",
        "CASE k % 8 WHEN 1 THEN c || chr(10) || CASE lv WHEN 1 THEN repeat('=', strlen(c)) || chr(10) WHEN 2 THEN repeat('-', strlen(c)) || chr(10) ELSE '' END || chr(10) WHEN 2 THEN '    x < ' || k || ' _y_' || chr(10) || chr(10) WHEN 3 THEN 'x < ' || k || ' _y_' || chr(10) || chr(10) WHEN 4 THEN CASE WHEN q = '' THEN '>' || chr(10) ELSE q || '>' || chr(10) END || chr(10) WHEN 5 THEN t || chr(10) WHEN 6 THEN repeat('─', 40) || chr(10) || chr(10) ELSE c || chr(10) || chr(10) END", "''"),
    "latex": ("'\\item' || CASE f WHEN 'A' THEN '[$\\boxtimes$] ' WHEN 'R' THEN '[$\\square$] ' ELSE ' ' END || x || chr(10) || chr(10)", "x || chr(10) || chr(10)", "''",
        "CASE k % 8 WHEN 1 THEN '\\' || ['section', 'subsection', 'subsubsection', 'paragraph'][lv] || '{' || c || '}' || CASE WHEN k % 3 = 0 THEN '\\label{h-' || k || '}' ELSE '' END || chr(10) WHEN 2 THEN CASE WHEN k % 5 = 0 THEN '\\begin{lstlisting}[language=py]' ELSE '\\begin{verbatim}' END || chr(10) || 'x < ' || k || ' _y_' || chr(10) || CASE WHEN k % 5 = 0 THEN '\\end{lstlisting}' ELSE '\\end{verbatim}' END || chr(10) WHEN 3 THEN CASE WHEN k % 3 = 0 THEN '\\begin{equation}' || chr(10) || '\\label{h-' || k || '}' || chr(10) || 'x < ' || k || ' _y_' || chr(10) || '\\end{equation}' ELSE '\\[' || chr(10) || 'x < ' || k || ' _y_' || chr(10) || '\\]' END || chr(10) WHEN 4 THEN '\\begin{quote}' || chr(10) || q || '\\end{quote}' || chr(10) WHEN 5 THEN CASE WHEN k % 16 = 5 THEN '\\begin{enumerate}' || chr(10) || CASE WHEN k % 4 != 1 THEN '\\setcounter{enumi}{' || (k % 4 - 1) || '}' || chr(10) ELSE '' END || t || '\\end{enumerate}' ELSE '\\begin{itemize}' || chr(10) || t || '\\end{itemize}' END || chr(10) WHEN 6 THEN chr(10) || '\\noindent\\rule{\\textwidth}{0.4pt}' || chr(10) || chr(10) ELSE c || chr(10) || chr(10) END", "''"),
    "typst": ("CASE WHEN k % 16 = 5 THEN '+ ' ELSE '- ' END || CASE f WHEN 'A' THEN '☑ ' WHEN 'R' THEN '☐ ' ELSE '' END || x || chr(10)", "x || chr(10)", "chr(10)",
        "CASE k % 8 WHEN 1 THEN repeat('=', lv) || ' ' || c || CASE WHEN k % 3 = 0 THEN ' <h_' || k || '>' ELSE '' END || chr(10) WHEN 2 THEN '```' || CASE WHEN k % 5 = 0 THEN 'py' ELSE '' END || chr(10) || 'x < ' || k || ' _y_' || chr(10) || '```' || chr(10) WHEN 3 THEN '$' || chr(10) || 'x < ' || k || ' _y_' || chr(10) || '$' || CASE WHEN k % 3 = 0 THEN ' <h_' || k || '>' ELSE '' END || chr(10) WHEN 4 THEN '#quote(block: true)[' || chr(10) || q || ']' || chr(10) WHEN 5 THEN CASE WHEN k % 16 = 5 AND k % 4 != 1 THEN '#set enum(start: ' || k % 4 || ')' || chr(10) ELSE '' END || t WHEN 6 THEN '#line(length: 100%)' || chr(10) ELSE c || chr(10) END", "chr(10)"),
}
BLOCK_SQL["myst"] = (*BLOCK_SQL["markdown"][:3], "CASE k % 8 WHEN 1 THEN CASE WHEN k % 3 = 0 THEN '(h_' || k || ')=' || chr(10) ELSE '' END || repeat('#', lv) || ' ' || c || chr(10) WHEN 3 THEN '```{math}' || chr(10) || CASE WHEN k % 3 = 0 THEN ':label: h_' || k || chr(10) ELSE '' END || 'x < ' || k || ' _y_' || chr(10) || '```' || chr(10) " + BLOCK_SQL["markdown"][3][BLOCK_SQL["markdown"][3].index("WHEN 2"):].replace("WHEN 3 THEN '$$' || chr(10) || 'x < ' || k || ' _y_' || chr(10) || '$$' || chr(10) || CASE WHEN k % 3 = 0 THEN '<!-- label: h_' || k || ' -->' || chr(10) ELSE '' END ", ""), "chr(10)")


def oracle(form: str) -> str:
    item, quote, between, block, sep = BLOCK_SQL[form]
    inline = INLINE_SQL[form].format(v=V) if form != "html" else INLINE_SQL[form]
    text = f"string_agg(b, {sep} ORDER BY k)"
    if form == "plain":
        text = f"trim({text}, ' ' || chr(10)) || chr(10)"
    return f"""WITH l AS (SELECT doc_id AS k, n, l_partkey AS p, l_suppkey AS s, l_returnflag AS f, l_partkey % 8 AS i, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS rn FROM {LINES}),
x AS (SELECT *, {inline} AS x FROM l), g AS (SELECT k, string_agg(x, '' ORDER BY n) AS c, string_agg({quote}, {between} ORDER BY n) AS q, string_agg({item}, '' ORDER BY n) AS t FROM x GROUP BY k),
o AS (SELECT o_custkey, o_orderkey AS k, CAST(o_orderkey % 7 % 4 + 1 AS INTEGER) AS lv FROM orders), j AS (SELECT o_custkey, o.k, lv, coalesce(c, '') AS c, coalesce(q, '') AS q, coalesce(t, '') AS t FROM o LEFT JOIN g ON g.k = o.k),
b AS (SELECT o_custkey AS doc_id, k, {block} AS b FROM j) SELECT doc_id, {text} AS text FROM b GROUP BY doc_id"""


def add(name: str, form: str) -> None:
    QUERIES[name] = lambda spark, d: r.render_documents(*corpus(spark, d), form)
    ORACLES[name] = oracle(form)


for number, form in (("b1", "html"), ("b3_b5", "markdown"), ("b6", "plain"), ("b8", "latex"), ("b9", "typst"), ("b10", "myst")):
    add(f"{number}_render_{form}", form)


def c1(spark, d):
    return r.inline_text(corpus(spark, d)[1], "alt")


QUERIES["c1_inline_text"] = c1
ORACLES["c1_inline_text"] = f"""SELECT o_custkey AS doc_id, CASE k % 8 WHEN 5 THEN k * 100 + 2 * n + 2 WHEN 4 THEN k * 100 + 2 * n + 1 ELSE k * 100 END AS pos,
  string_agg(CASE WHEN l_partkey % 8 IN (4, 6) THEN '' ELSE 'w' || l_suppkey || '_<' END, '' ORDER BY n) AS text FROM (SELECT *, doc_id AS k FROM {LINES}) JOIN orders ON o_orderkey = k WHERE k % 8 IN (0, 1, 4, 5, 7) GROUP BY ALL"""


def w1(spark, d):
    """Number, then render: the whole job on a corpus, as one chain."""
    blocks, inlines = corpus(spark, d)
    return r.render_documents(blocks, r.numbered_headings(blocks, inlines), "html")


def _counter(level: int) -> str:
    return f"(SELECT count(*) FROM o x WHERE x.o_custkey = o.o_custkey AND x.k % 8 = 1 AND x.lv = {level} AND x.k <= o.k AND x.k > coalesce((SELECT max(y.k) FROM o y WHERE y.o_custkey = o.o_custkey AND y.k % 8 = 1 AND y.lv < {level} AND y.k <= o.k), -1))"


QUERIES["w1_number_and_render"] = w1
ORACLES["w1_number_and_render"] = ORACLES["b1_render_html"].replace("coalesce(c, '') AS c", f"CASE WHEN o.k % 8 = 1 THEN array_to_string([{', '.join(_counter(v) for v in (1, 2, 3, 4))}][1:lv], '.') || ' ' ELSE '' END || coalesce(c, '') AS c")


def i4(spark, d):
    """Number sections and labels, resolve references, render: emphasised words refer to the label of their block's order."""
    blocks, inlines = corpus(spark, d)
    own = F.concat(F.lit("h_"), F.floor(F.col("pos") / 100).cast("long"))
    refer = inlines.withColumns({"value": F.when(F.col("kind") == "emphasis", own).otherwise(F.col("value")), "kind": F.when(F.col("kind") == "emphasis", "crossref").otherwise(F.col("kind"))})
    return r.render_documents(blocks, r.numbered_headings(blocks, r.resolved(blocks, refer)), "html")


QUERIES["i4_number_resolve_render"] = i4
ORACLES["i4_number_resolve_render"] = ORACLES["w1_number_and_render"].replace("'<em>w' || s || '_&lt;</em>'", """CASE WHEN k % 24 = 9 THEN 'Section ' || (SELECT count(*) FROM orders z, orders y WHERE y.o_orderkey = l.k AND z.o_custkey = y.o_custkey AND z.o_orderkey % 24 = 9 AND z.o_orderkey <= l.k) ELSE '<a href="#h_' || k || '" class="crossref">[h_' || k || ']</a>' END""")
