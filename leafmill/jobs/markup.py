"""Markup sources: each customer's orders written as snippets of a format and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.jobs.pages import LINES, lines
from leafmill.operators.documents import render_documents
from leafmill.operators.render import in_order
from leafmill.sources import docx, latex, markdown, typst
from leafmill.tables import spread

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def snippets(spark: SparkSession, d: str, forms: list[str], sep: str = "\n\n") -> DataFrame:
    """One text for each customer: an order's snippet is forms[key % len] with # for the key and @ for a level of 1 to 3."""
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, forms)), (k % len(forms) + 1).cast("int"))
    said = F.replace(form, F.lit("#"), k.cast("string"))
    said = F.when(F.contains(said, F.lit("@=")), F.replace(said, F.lit("@="), F.repeat(F.lit("="), (k % 3 + 1).cast("int")))).otherwise(F.replace(F.replace(said, F.lit("@sub"), F.repeat(F.lit("sub"), (k % 3).cast("int"))), F.lit("@"), F.repeat(F.lit("\x02"), (k % 3 + 1).cast("int"))))
    said = F.replace(said, F.lit("\x02"), F.lit("#"))
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("doc_id")).agg(in_order("o_orderkey", piece=said, sep=sep).alias("text"))


def nth(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).cast("long")).drop("pos")


def expected(cases: dict[int, dict], n: int, gone: str = "false") -> str:
    """SQL rows of the blocks of each customer, from a table of cases by order key."""
    def pick(column: str) -> str:
        if not any(column in c for c in cases.values()):
            return "CAST(NULL AS VARCHAR)"
        return "CASE k % " + str(n) + " " + " ".join(f"WHEN {i} THEN {c[column]}" for i, c in cases.items() if column in c) + " END"

    return f"""SELECT doc_id, {pick('kind')} AS kind, CAST({pick('level')} AS INTEGER) AS level, {pick('ident')} AS ident, {pick('language')} AS language, {pick('text')} AS text, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth
FROM (SELECT o_custkey AS doc_id, o_orderkey AS k FROM orders) WHERE NOT ({gone})"""


MD = ["Para # text\nmore *e*", "@ Title # {\x02h-\x02}", "```py\ncode #\n\x02 no heading\n```", "$$\nx_#\n$$", "> quote #\n> more", "- item #\n- other", "---", "[^n#]: note #"]
MD_CASES = {
    0: {"kind": "'paragraph'", "text": "'Para ' || k || ' text' || chr(10) || 'more *e*'"}, 1: {"kind": "'heading'", "level": "k % 3 + 1", "ident": "'h-' || k", "text": "'Title ' || k"},
    2: {"kind": "'code'", "language": "'py'", "text": "'code ' || k || chr(10) || '# no heading'"}, 3: {"kind": "'math'", "text": "'x_' || k"}, 4: {"kind": "'blockquote'", "text": "'quote ' || k || chr(10) || 'more'"},
    5: {"kind": "'list'", "text": "'- item ' || k || chr(10) || '- other'"}, 6: {"kind": "'rule'", "text": "''"}, 7: {"kind": "'footnote'", "ident": "'n' || k", "text": "'note ' || k"},
}


@query("a3_markdown_blocks", expected(MD_CASES, 8))
def a3(spark, d):
    forms = [f.replace("{\x02h-\x02}", "{\x03h-#}") for f in MD]
    docs = snippets(spark, d, forms).withColumn("text", F.replace("text", F.lit("\x03"), F.lit("#")))
    return nth(markdown.markdown_blocks(docs))


# Whole documents: what stands for an order in Markdown, and in HTML and LaTeX (# is its key, N a line end).
WHOLE = [
    ("Para #Nmore *e* and `c<d`", "<p>Para #Nmore <em>e</em> and <code>c&lt;d</code></p>N", "Para #Nmore \\emph{e} and \\texttt{c<d}NN"),
    ("@ Title # {\x03h-#}", '<h@ id="h-#">Title #</h@>N', "\\@{Title #}\\label{h-#}N"),
    ("```pyNcode #NN\x03 no headingN```", '<pre><code class="language-py">code #NN\x03 no headingN</code></pre>N', "\\begin{lstlisting}[language=py]Ncode #NN\x03 no headingN\\end{lstlisting}N"),
    ("> quote #N> - a *b*N> - cN>N> end", "<blockquote>N<p>quote #</p>N<ul>N<li><p>a <em>b</em></p>N</li>N<li><p>c</p>N</li>N</ul>N<p>end</p>N</blockquote>N", "\\begin{quote}Nquote #NN\\begin{itemize}N\\tightlistN\\item a \\emph{b}NN\\item cNN\\end{itemize}NendNN\\end{quote}N"),
    ("3. one #N   - [x] in **b**N   - [ ] twoNN     moreN4. last", '<ol start="3">N<li><p>one #</p>N<ul>N<li class="task-list-item"><input type="checkbox" checked disabled> <p>in <strong>b</strong></p>N</li>N<li><p>two</p>N<p>more</p>N</li>N</ul>N</li>N<li><p>last</p>N</li>N</ol>N', "\\begin{enumerate}N\\tightlistN\\setcounter{enumi}{2}N\\item one #NN\\begin{itemize}N\\item[$\\boxtimes$] in \\textbf{b}NN\\item twoNNmoreNN\\end{itemize}N\\item lastNN\\end{enumerate}N"),
    ("| A | *B* |N|---|--:|N| # | x\\|**y `z`** |", '<table>N<thead>N<tr><th><p>A</p>N</th><th style="text-align: right"><p><em>B</em></p>N</th></tr>N</thead>N<tbody>N<tr><td><p>#</p>N</td><td style="text-align: right"><p>x|<strong>y <code>z</code></strong></p>N</td></tr>N</tbody>N</table>N', "\\begin{longtable}[]{@{}lr@{}}N\\topruleN\\textbf{A} & \\textbf{\\emph{B}} \\\\N\\midruleN# & x|\\textbf{y \\texttt{z}} \\\\N\\bottomruleN\\end{longtable}N"),
    ("- seeNN  ```pyN  - x = #N  ```N- end", '<ul>N<li><p>see</p>N<pre><code class="language-py">- x = #N</code></pre>N</li>N<li><p>end</p>N</li>N</ul>N', "\\begin{itemize}N\\item seeNN\\begin{lstlisting}[language=py]N- x = #N\\end{lstlisting}N\\item endNN\\end{itemize}N"),
    ("[^n#]: note #", '<aside id="fn-n#" class="footnote" role="note">N<p>note #</p>N</aside>N', "\\footnotetext[n#]{note #}N"),
    ("***b i #***, **a *b* c** and [x **y** `z`](u# \"t\")N[[no]] ~~s *e*~~ H~2~O", '<p><em><strong>b i #</strong></em>, <strong>a <em>b</em> c</strong> and <a href="u#" title="t">x <strong>y</strong> <code>z</code></a>N[[no]] <del>s <em>e</em></del> H<sub>2</sub>O</p>N', "\\emph{\\textbf{b i #}}, \\textbf{a \\emph{b} c} and \\href{u#}{x \\textbf{y} \\texttt{z}}N[[no]] \\sout{s \\emph{e}} H\\textsubscript{2}ONN"),
    ("Over #N====NNsee [a #], [the b][B #] and [none]NN[a #]: u#NN[b #]: <v#> 'T'", '<h1 id="over-#">Over #</h1>N<p>see <a href="u#">a #</a>, <a href="v#" title="T">the b</a> and [none]</p>N', "\\section{Over #}\\label{over-#}Nsee \\href{u#}{a #}, \\href{v#}{the b} and [none]NN"),
    ("\"Say #\" it's -- a *\"b\"* ...", "<p>“Say #” it’s – a <em>“b”</em> …</p>N", "“Say #” it’s – a \\emph{“b”} …NN"),
]
#: The place of the note among them.
NOTE = 7


def whole_documents(spark, d):
    """Each customer's orders as one Markdown document, a rule between them."""
    forms = [m.replace("N", "\n") for m, _, _ in WHOLE]
    docs = snippets(spark, d, forms, "\n\n***\n\n").withColumn("text", F.replace("text", F.lit("\x03"), F.lit("#")))
    return markdown.markdown_documents(docs)


def whole_expected(column: int, level: str, rule: str) -> str:
    """Rules stand between the orders of a customer; notes come last."""
    forms = " ".join(f"WHEN {i} THEN '{w[column].replace(chr(39), chr(39) * 2)}'" for i, w in enumerate(WHOLE))
    n = len(WHOLE)
    said = f"replace(replace(replace(replace(replace(replace(CASE k % {n} {forms} END, '@{{}}', chr(5)), '[none]', chr(4)), '#', CAST(k AS VARCHAR)), '@', {level}), 'N', chr(10)), chr(3), '#')"
    return f"""SELECT doc_id, replace(replace(string_agg(CASE WHEN k % {n} = {NOTE} THEN '' ELSE {said} END, '{rule}' || chr(10) ORDER BY k) || coalesce(string_agg(CASE WHEN k % {n} = {NOTE} THEN {said} END, '' ORDER BY k), ''), chr(4), '[none]'), chr(5), '@{{}}') AS text
FROM (SELECT o_custkey AS doc_id, o_orderkey AS k FROM orders) GROUP BY doc_id"""


@query("w1_markdown_to_html", whole_expected(1, "CAST(k % 3 + 1 AS VARCHAR)", "<hr>"))
def w1_html(spark, d):
    """Whole Markdown documents to HTML: lists in lists and quotes, code in items, tables, notes, nested inlines, link definitions."""
    return render_documents(whole_documents(spark, d), None, "html")


@query("w1_markdown_to_latex", whole_expected(2, "repeat('sub', CAST(k % 3 AS INTEGER)) || 'section'", "' || chr(10) || '\\noindent\\rule{\\textwidth}{0.4pt}' || chr(10) || '"))
def w1_latex(spark, d):
    """Whole Markdown documents to LaTeX."""
    return render_documents(whole_documents(spark, d), None, "latex")


def lines_of(spark, d):
    """Order lines dealt out over all tasks, before they are texts: each is small but takes long to read."""
    return spread(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))


@query("a4_markdown_inlines", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_suppkey, l_extendedprice FROM lineitem), x AS (
  SELECT *, 0 AS ipos, 'text' AS kind, 'See ' AS value, NULL AS url FROM l UNION ALL SELECT *, 1, 'strong', 'b' || k, NULL FROM l UNION ALL SELECT *, 2, 'text', ', ', NULL FROM l UNION ALL SELECT *, 3, 'link', 't' || k, 'u' || k FROM l
  UNION ALL SELECT *, 4, 'code', 'c*d*' || k, NULL FROM l UNION ALL SELECT *, 5, 'text', ' 5 * 6 ', NULL FROM l UNION ALL SELECT *, 6, 'footnote_ref', 'n' || k, NULL FROM l UNION ALL SELECT *, 7, 'math', 'x_1+y', NULL FROM l UNION ALL SELECT *, 8, 'image', 'a', 'i' || k FROM l)
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, ipos, kind, value, url FROM x""")
def a4(spark, d):
    k = F.col("l_partkey")
    text = F.concat(F.lit("See **b"), k, F.lit("**, [t"), k, F.lit("](u"), k, F.lit(")`c*d*"), k, F.lit("` 5 * 6 [^n"), k, F.lit("]$x_1+y$![a](i"), k, F.lit(")"))
    return markdown.markdown_inlines(lines_of(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", text.alias("text")))


@query("a5_display_math", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'math' ELSE 'paragraph' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'x_' || p_partkey WHEN 1 THEN 'see $$x$$' ELSE '$$a$$ $$b$$' END AS text FROM part")
def a5(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit(" $$ x_"), k, F.lit(" $$"))).when(k % 3 == 1, "see $$x$$").otherwise("$$a$$ $$b$$")
    return markdown.promote_math(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.lit("paragraph").alias("kind"), text.alias("text")))


@query("c13_bracketed_spans", "SELECT p_partkey, 0 AS n, 'a [' || p_name || '] b' AS text, 's' || p_partkey AS id, lower(p_type) AS classes FROM part")
def c13(spark, d):
    text = F.concat(F.lit("x [a ["), "p_name", F.lit("] b]{#s"), "p_partkey", F.lit(" ."), F.lower("p_type"), F.lit("} [no]{bad} [link](u)"))
    return markdown.bracketed_spans(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", text.alias("text"))).withColumn("classes", F.array_join("classes", " "))


@query("c14_c15_inline_attrs", """SELECT p_partkey AS doc_id, 0 AS ipos, CASE p_partkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'image' ELSE 'code' END AS kind, 'v' AS value, CASE p_partkey % 3 WHEN 0 THEN 'html' END AS format, CASE p_partkey % 3 WHEN 1 THEN CAST(p_size AS VARCHAR) END AS width FROM part
  UNION ALL SELECT p_partkey, 1, 'text', CASE p_partkey % 3 WHEN 2 THEN ' {no}' ELSE ' rest' END, NULL, NULL FROM part""")
def c14(spark, d):
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{d}/part.parquet").select(k.alias("doc_id"), F.lit(0).alias("pos"), "p_size")
    first = p.select("doc_id", "pos", F.lit(0).alias("ipos"), F.when(F.col("doc_id") % 3 == 1, "image").otherwise("code").alias("kind"), F.lit("v").alias("value"), F.lit(None).cast("string").alias("url"))
    said = F.when(F.col("doc_id") % 3 == 0, "{=html} rest").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("{width="), "p_size", F.lit("} rest"))).otherwise(" {no}")
    second = p.select("doc_id", "pos", F.lit(1).alias("ipos"), F.lit("text").alias("kind"), said.alias("value"), F.lit(None).cast("string").alias("url"))
    return markdown.attributed(first.unionByName(second)).select("doc_id", "ipos", "kind", "value", "format", F.col("attrs.kv")["width"].alias("width"))


@query("c17_front_matter", """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 4 != 0 THEN 'A: ' || p_name END AS title, CASE WHEN p_partkey % 4 != 0 THEN lower(p_type) || ';' || p_size END AS keywords, CASE p_partkey % 4 WHEN 1 THEN 'Jane' WHEN 2 THEN 'Jane;Joe' END AS authors,
  CASE WHEN p_partkey % 4 != 0 THEN 'x' END AS lang, CASE WHEN p_partkey % 4 != 0 THEN 'Body ' || p_partkey ELSE 'Body ' || p_partkey || chr(10) || '---' END AS body FROM part""")
def c17(spark, d):
    k = F.col("p_partkey")
    authors = F.when(k % 4 == 1, "author: Jane\n").when(k % 4 == 2, "authors:\n  - Jane\n  - 'Joe'\n").otherwise("")
    text = F.when(k % 4 == 0, F.concat(F.lit("Body "), k, F.lit("\n---"))).otherwise(F.concat(F.lit('---\ntitle: "A: '), "p_name", F.lit('"\ntags: ['), F.lower("p_type"), F.lit(", "), "p_size", F.lit("]\n"), authors, F.lit("lang: x\n---\nBody "), k))
    out = markdown.front_matter(spark.read.parquet(f"{d}/part.parquet").select(k.alias("doc_id"), text.alias("text")))
    return out.select("doc_id", "title", F.array_join("keywords", ";").alias("keywords"), F.array_join("authors", ";").alias("authors"), F.try_element_at("rest", F.lit("lang")).alias("lang"), "body")


def nested(spark, d):
    """Parts as documents whose front matter has authors in three forms, a folded text, and maps in lists in maps."""
    k = F.col("p_partkey")
    authors = F.when(k % 4 == 1, F.concat(F.lit("author:\n  - name: Jane "), k, F.lit("\n    affiliation: "), "p_brand", F.lit("\n  - 'Joe'\n"))).when(k % 4 == 2, F.concat(F.lit("author: Solo "), k, F.lit("\n"))).otherwise(F.concat(F.lit("authors: [A, {name: B "), k, F.lit("}]\n")))
    head = F.concat(F.lit('---\ntitle: "A: '), "p_name", F.lit('"\n'), authors, F.lit("abstract: >\n  First "), k, F.lit("\n  line\n\n  last\ntags: ["), F.lower("p_type"), F.lit(", "), "p_size", F.lit(', "x, y"]\nlayout:\n  size: '), "p_size", F.lit(" # of a part\n  parts:\n  - {name: "), "p_type", F.lit(", ok: true}\n  - null\n---\n"))
    text = F.concat(F.when(k % 4 == 0, "").otherwise(head), F.lit("Body "), k)
    return spread(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(k.alias("doc_id"), text.alias("text"))


@query("c17_nested_metadata", """SELECT doc_id, body, CASE WHEN m THEN title END AS title, CASE WHEN m THEN abstract END AS abstract, CASE WHEN m THEN keywords END AS keywords, CASE WHEN m THEN authors END AS authors, CASE WHEN m THEN custom END AS custom FROM (
  SELECT p_partkey AS doc_id, p_partkey % 4 != 0 AS m, 'Body ' || p_partkey AS body, 'A: ' || p_name AS title, 'First ' || p_partkey || ' line' || chr(10) || 'last' || chr(10) AS abstract, lower(p_type) || '|x, y' AS keywords,
  CASE p_partkey % 4 WHEN 1 THEN 'Jane ' || p_partkey || ' of ' || p_brand || '|Joe' WHEN 2 THEN 'Solo ' || p_partkey ELSE 'A|B ' || p_partkey END AS authors, '{"layout":{"parts":[{"name":"' || p_type || '","ok":true},null],"size":' || p_size || '}}' AS custom FROM part)""")
def c17_nested(spark, d):
    out = markdown.document_metadata(nested(spark, d))
    said = F.transform("authors", lambda a: F.concat_ws(" of ", a["name"], a["affiliation"]))
    return out.select("doc_id", "body", "title", "abstract", F.array_join("keywords", "|").alias("keywords"), F.array_join(said, "|").alias("authors"), F.to_json("custom").alias("custom"))


@query("b11_document_tree", """SELECT p_partkey AS doc_id, CAST(p_size AS VARCHAR) AS size, '{"content":[{"type":"Heading","level":1,"id":"t-' || p_partkey || '-x","content":[{"type":"Text","value":"T ' || p_partkey || ' "},{"type":"Emphasis","content":[{"type":"Text","value":"x"}]}]},{"type":"List","ordered":true,"start":3,"tight":true,"items":['
  || '{"type":"ListItem","content":[{"type":"Paragraph","content":[{"type":"Text","value":"a "},{"type":"Strong","content":[{"type":"Text","value":"b "},{"type":"Emphasis","content":[{"type":"Text","value":"c"}]}]}]},{"type":"List","ordered":false,"tight":true,"items":[{"type":"ListItem","checked":true,"content":[{"type":"Paragraph","content":[{"type":"Link","url":"u' || p_size || '","title":"' || p_brand || '","content":[{"type":"Text","value":"l"}]}]}]}]}]},'
  || '{"type":"ListItem","content":[{"type":"Paragraph","content":[{"type":"Code","value":"d"}]}]}]},{"type":"BlockQuote","content":[{"type":"Paragraph","content":[{"type":"Text","value":"q ' || p_size || '"}]}]},{"type":"CodeBlock","language":"py","content":"' || p_size || chr(92) || 'n"}]}' AS json FROM part""")
def b11_tree(spark, d):
    """The tree of each document in JSON; size is read back from it as VARIANT."""
    from leafmill.operators.tree import tree_json

    k = F.col("p_partkey")
    text = F.concat(F.lit("# T "), k, F.lit(" *x*\n\n3. a **b *c***\n   - [x] [l](u"), "p_size", F.lit(' "'), "p_brand", F.lit('")\n4. `d`\n\n> q '), "p_size", F.lit("\n\n```py\n"), "p_size", F.lit("\n```"))
    out = tree_json(markdown.markdown_documents(spark.read.parquet(f"{d}/part.parquet").select(k.alias("doc_id"), text.alias("text"))))
    return out.select("doc_id", "json", F.regexp_extract(F.variant_get(F.parse_json("json"), "$.content[2].content[0].content[0].value", "string"), r"q (\d+)", 1).alias("size"))


TEX = ["Para #\ntext $m$", "\\@subsection{T #}\\label{s:#}", "\\begin{verbatim}\ncode #\n\\end{verbatim}", "\\begin{equation}\\label{eq:#} x_# \\end{equation}", "\\begin{quote}q #\\end{quote}", "\\begin{itemize}\\item a # \\item b\\end{itemize}", "\\begin{foo}f #\\end{foo}", "\\[ y_# \\]"]
TEX_CASES = {
    0: {"kind": "'paragraph'", "text": "'Para ' || k || ' text $m$'"}, 1: {"kind": "'heading'", "level": "k % 3 + 1", "ident": "'s:' || k", "text": "'T ' || k"}, 2: {"kind": "'code'", "text": "'code ' || k"}, 3: {"kind": "'math'", "ident": "'eq:' || k", "text": "'x_' || k"},
    4: {"kind": "'blockquote'", "text": "'q ' || k"}, 5: {"kind": "'list'", "text": "'\\item a ' || k || ' \\item b'"}, 6: {"kind": "'raw'", "text": "'f ' || k"}, 7: {"kind": "'math'", "text": "'y_' || k"},
}


def tex(spark, d):
    return latex.latex_blocks(snippets(spark, d, TEX))


@query("a14_latex_blocks", expected(TEX_CASES, 8))
def a14(spark, d):
    return nth(tex(spark, d)).drop("warning")


@query("a14_latex_warnings", "SELECT o_custkey AS doc_id, 'unknown environment: foo' AS warning, count(*) AS n FROM orders WHERE o_orderkey % 8 = 6 GROUP BY o_custkey")
def a14w(spark, d):
    return tex(spark, d).where("warning IS NOT NULL").groupBy("doc_id", "warning").agg(F.count("*").alias("n"))


@query("a14_latex_items", "SELECT o_custkey AS doc_id, item, count(*) AS n FROM orders, (VALUES (0), (1)) t(item) WHERE o_orderkey % 8 = 5 GROUP BY ALL")
def a14i(spark, d):
    return latex.latex_items(tex(spark, d), ["doc_id", "pos"]).groupBy("doc_id", "item").agg(F.count("*").alias("n"))


@query("a15_latex_preamble", "SELECT p_partkey AS doc_id, 'On {' || p_name || '}' AS title, p_brand || ';' || p_type AS authors, '1 May' AS date, chr(10) || 'Body ' || p_partkey || chr(10) AS body FROM part")
def a15(spark, d):
    text = F.concat(F.lit("\\documentclass{article}\n\\title{On {"), "p_name", F.lit("}}\n\\author{"), "p_brand", F.lit(" \\and "), "p_type", F.lit("}\n\\date{1 May}\n\\begin{document}\nBody "), "p_partkey", F.lit("\n\\end{document}\n"))
    out = latex.latex_preamble(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return out.withColumn("authors", F.array_join("authors", ";"))


@query("a16_latex_inlines", """SELECT p_partkey, n, CASE n WHEN 0 THEN 'emphasis' WHEN 1 THEN 'link' WHEN 2 THEN 'citation' WHEN 3 THEN 'math' WHEN 4 THEN 'crossref' ELSE 'footnote' END AS kind,
  CASE n WHEN 0 THEN p_name WHEN 1 THEN 't' WHEN 2 THEN 'k' || p_partkey WHEN 3 THEN 'x^2' WHEN 4 THEN 'f:' || p_partkey ELSE 'n {b}' END AS value, CASE n WHEN 1 THEN 'http://u/' || p_partkey END AS url FROM part, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS n)""")
def a16(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("A \\emph{"), "p_name", F.lit("} \\href{http://u/"), k, F.lit("}{t} \\citet{k"), k, F.lit("} $x^2$ \\autoref{f:"), k, F.lit("}\\footnote{n {b}} \\foo{x}"))
    return latex.latex_inlines(spark.read.parquet(f"{d}/part.parquet").select(k, text.alias("text"))).drop("command")


@query("a17_latex_tabular", f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS row, 0 AS col, CAST(l_partkey AS VARCHAR) AS text, 'left' AS align FROM {LINES} UNION ALL SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER), 1, 's \\& ' || l_suppkey, 'right' FROM {LINES}
  UNION ALL SELECT DISTINCT l_orderkey, 0, 0, 'Part', 'left' FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 0, 1, 'Supplier', 'right' FROM lineitem""")
def a17(spark, d):
    row = F.concat(F.col("l_partkey").cast("string"), F.lit(" & s \\& "), F.col("l_suppkey"), F.lit(" \\\\ \\hline\n"))
    body = F.concat(F.lit("\\toprule Part & Supplier \\\\\n\\midrule\n"), in_order("n", piece=row), F.lit(" & \\\\ \\bottomrule"))
    return latex.tabular_cells(lines(spark, d).groupBy("doc_id").agg(F.lit("|l|r@{x}").alias("spec"), body.alias("text")))


TYP = ["Para #", "@= T # <h-#>", "```py\ncode #\n= no\n```", "$\nx_#\n$ <e-#>", "- a #\n- b", '\x02image("#.png")\n<f-#>', "\x02set text(1pt)", "Other #\nline"]
TYP_CASES = {
    0: {"kind": "'paragraph'", "text": "'Para ' || k"}, 1: {"kind": "'heading'", "level": "k % 3 + 1", "ident": "'h-' || k", "text": "'T ' || k"}, 2: {"kind": "'code'", "language": "'py'", "text": "'code ' || k || chr(10) || '= no'"}, 3: {"kind": "'math'", "ident": "'e-' || k", "text": "'x_' || k"},
    4: {"kind": "'list'", "text": "'- a ' || k || chr(10) || '- b'"}, 5: {"kind": "'call'", "ident": "'f-' || k", "text": "'#image(\"' || k || '.png\")'"}, 7: {"kind": "'paragraph'", "text": "'Other ' || k || chr(10) || 'line'"},
}


@query("a24_a26_typst_blocks", expected(TYP_CASES, 8, "k % 8 = 6"))
def a24(spark, d):
    return nth(typst.typst_blocks(snippets(spark, d, TYP)))


@query("a25_typst_inlines", """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey AS k, l_suppkey, l_extendedprice FROM lineitem), x AS (SELECT *, 0 AS ipos, 'text' AS kind, 'See ' AS value, CAST(NULL AS VARCHAR) AS url FROM l UNION ALL SELECT *, 1, 'strong', 'b' || k, CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 2, 'text', ', ', CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 3, 'emphasis', 'e ' || k, CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 4, 'text', ' ', CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 5, 'crossref', 'fig:' || k, CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 6, 'text', ', ', CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 7, 'link', 't' || k, 'u' || k FROM l UNION ALL SELECT *, 8, 'text', ' ', CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 9, 'math', 'x_1', CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 10, 'text', ' me@b.c 5 * 6 ', CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 11, 'code', 'a*b*', CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 12, 'superscript', '2', CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 13, 'citation', 'p' || k, CAST(NULL AS VARCHAR) FROM l UNION ALL SELECT *, 14, 'text', ' #other[x]', CAST(NULL AS VARCHAR) FROM l)
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, ipos, kind, value, url FROM x""")
def a25(spark, d):
    k, s = F.col("l_partkey"), F.lit
    text = F.concat(s("See *b"), k, s("*, _e "), k, s("_ @fig:"), k, s(', #link("u'), k, s('")[t'), k, s("] $x_1$ me@b.c 5 * 6 `a*b*`#super[2]#cite(<p"), k, s(">) #other[x]"))
    return typst.typst_inlines(lines_of(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", text.alias("text")))


@query("a27_typst_metadata", "SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'F' || p_partkey END AS title, CASE WHEN p_partkey % 3 != 2 THEN p_brand END AS author FROM part")
def a27(spark, d):
    k = F.col("p_partkey")
    said = F.concat(F.lit('#set document(title: "'), "p_name", F.lit('", author: "'), "p_brand", F.lit('")\nBody'))
    text = F.when(k % 3 == 0, said).when(k % 3 == 1, F.concat(F.lit("---\ntitle: F"), k, F.lit("\n---\n"), said)).otherwise("Body")
    return typst.typst_metadata(spark.read.parquet(f"{d}/part.parquet").select(k.alias("doc_id"), text.alias("text")))


@query("a20_a21_myst_directives", """WITH p AS (SELECT p_partkey AS k, p_name FROM part)
SELECT k AS doc_id, 'note' AS name, 'T ' || k AS arg, 'admonition' AS kind, NULL AS label, p_name AS body FROM p WHERE k % 3 = 0
UNION ALL SELECT k, 'figure', k || '.png', 'figure', 'f-' || k, p_name FROM p WHERE k % 3 = 1
UNION ALL SELECT k, 'custom', NULL, 'div', NULL, ':::{tip}' || chr(10) || 'in' || chr(10) || ':::' || chr(10) || p_name FROM p WHERE k % 3 = 2 UNION ALL SELECT k, 'tip', NULL, 'admonition', NULL, 'in' FROM p WHERE k % 3 = 2""")
def a20(spark, d):
    k = F.col("p_partkey")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("x\n:::{note} T "), k, F.lit("\n"), "p_name", F.lit("\n:::\ny")))
        .when(k % 3 == 1, F.concat(F.lit("```{figure} "), k, F.lit(".png\n:name: f-"), k, F.lit("\n:width: 3\n"), "p_name", F.lit("\n```")))
        .otherwise(F.concat(F.lit("::::{custom}\n:::{tip}\nin\n:::\n"), "p_name", F.lit("\n::::")))
    )
    out = typst.myst_directives(spark.read.parquet(f"{d}/part.parquet").select(k.alias("doc_id"), text.alias("text")))
    return out.select("doc_id", "name", "arg", "kind", F.try_element_at("options", F.lit("name")).alias("label"), "body")


@query("a22_myst_roles", "SELECT p_partkey, 0 AS n, 'numref' AS role, 'crossref' AS kind, 'f-' || p_partkey AS target FROM part UNION ALL SELECT p_partkey, 1, 'doc', 'link', 'd-' || p_partkey FROM part UNION ALL SELECT p_partkey, 2, 'kbd', 'span.role-kbd', p_name FROM part")
def a22(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit("see {numref}`f-"), k, F.lit("` and {doc}`Title <d-"), k, F.lit(">` or {kbd}`"), "p_name", F.lit("` {x} `y`"))
    return typst.myst_roles(spark.read.parquet(f"{d}/part.parquet").select(k, text.alias("text")))


@query("a23_attach_labels", """WITH b AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'label' WHEN 1 THEN 'figure' ELSE 'paragraph' END AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT b.doc_id, b.pos, b.kind, CASE WHEN b.kind = 'figure' THEN 'l' || p.pos END AS ident, CASE WHEN b.kind != 'figure' THEN 'l' || p.pos END AS wrapped FROM b LEFT JOIN b p ON p.doc_id = b.doc_id AND p.rn = b.rn - 1 AND p.kind = 'label' WHERE b.kind != 'label'""")
def a23(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "label").when(k % 4 == 1, "figure").otherwise("paragraph")
    return typst.attach_labels(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), kind.alias("kind"), F.when(kind == "label", F.concat(F.lit("l"), k)).alias("ident")))


# ---- DOCX ------------------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def _package(names: pd.Series, texts: pd.Series) -> pd.Series:
    """A package with a heading and a bold paragraph."""
    import io
    import zipfile

    def one(name: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
            z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{name}</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{text}</w:t><w:br/><w:t>end</w:t></w:r></w:p></w:body></w:document>')
        return out.getvalue()

    return pd.Series([one(a, b) for a, b in zip(names, texts, strict=True)])


@query("a28_docx_blocks", "SELECT c_custkey AS doc_id, 0 AS pos, 'Heading1' AS style, c_name AS text, false AS bold FROM customer UNION ALL SELECT c_custkey, 1, NULL, c_mktsegment || chr(10) || 'end', true FROM customer")
def a28(spark, d):
    customers = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"))
    files = customers.select(F.col("c_custkey").alias("doc_id"), _package("c_name", "c_mktsegment").alias("data"))
    return docx.docx_blocks(files).select("doc_id", "pos", "style", "text", "bold")


@query("a29_docx_style_kind", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'heading' || (p_size % 6 + 1) WHEN 1 THEN 'heading' || (p_size % 6 + 1) WHEN 2 THEN 'code' WHEN 3 THEN 'quote' ELSE 'normal' END AS kind FROM part")
def a29(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_size") % 6 + 1
    style = F.when(k == 0, F.concat(F.lit("Überschrift"), n)).when(k == 2, "Source Code").when(k == 3, "IntenseQuote").otherwise("Subtitle")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", docx.style_kind(style, F.when(k == 1, n - 1)).alias("kind"))


@query("a30_docx_numbering", "SELECT p_partkey AS num_id, s_suppkey % 3 AS level, CASE s_suppkey % 3 WHEN 0 THEN 'decimal' WHEN 1 THEN 'bullet' ELSE 'lowerRoman' END AS format, s_suppkey % 3 != 1 AS ordered FROM part JOIN supplier ON s_suppkey // 3 = p_partkey % 10")
def a30(spark, d):
    nums = spark.read.parquet(f"{d}/part.parquet").select(F.lit(1).alias("doc_id"), F.col("p_partkey").alias("num_id"), (F.col("p_partkey") % 10).alias("abstract_id"))
    s = F.col("s_suppkey")
    levels = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit(1).alias("doc_id"), F.floor(s / 3).alias("abstract_id"), (s % 3).alias("level"), F.when(s % 3 == 0, "decimal").when(s % 3 == 1, "bullet").otherwise("lowerRoman").alias("format"))
    return docx.numbering_formats(nums, levels).select("num_id", "level", "format", "ordered")


@query("a31_docx_relationships", "SELECT l_orderkey AS doc_id, 'rId' || l_linenumber AS r_id, l_partkey, CASE WHEN p_partkey IS NOT NULL THEN CASE p_partkey % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'image' ELSE 'other' END END AS kind, 't' || p_partkey AS target FROM lineitem LEFT JOIN (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p_partkey FROM lineitem WHERE l_linenumber != 3 GROUP BY ALL) ON o = l_orderkey AND n = l_linenumber")
def a31(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    runs = li.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("rId"), "l_linenumber").alias("r_id"), "l_partkey")
    rels = li.where("l_linenumber != 3").groupBy(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("rId"), "l_linenumber").alias("r_id")).agg(F.min("l_partkey").alias("p"))
    kind = F.concat(F.lit("http://x/"), F.element_at(F.array(F.lit("hyperlink"), F.lit("image"), F.lit("styles")), (F.col("p") % 3 + 1).cast("int")))
    return docx.relationships(runs, rels.select("doc_id", "r_id", kind.alias("type"), F.concat(F.lit("t"), "p").alias("target"))).select("doc_id", "r_id", "l_partkey", "kind", "target")


@query("a32_docx_vmerge", f"""WITH l AS (SELECT doc_id, n, l_partkey, l_partkey % 3 != 0 AS starts FROM {LINES}), g AS (SELECT *, (SELECT max(x.n) FROM l x WHERE x.doc_id = l.doc_id AND x.n <= l.n AND x.starts) AS head FROM l)
SELECT doc_id, head AS row, arg_min(l_partkey, n) AS part, CAST(count(*) AS INTEGER) AS rowspan FROM g WHERE head IS NOT NULL GROUP BY doc_id, head""")
def a32(spark, d):
    cells = lines(spark, d).select("doc_id", F.col("n").alias("row"), F.lit(0).alias("col"), F.col("l_partkey").alias("text"), F.when(F.col("l_partkey") % 3 == 0, "continue").when(F.col("l_partkey") % 3 == 1, "restart").alias("vmerge"))
    return docx.merged_cells(cells).select("doc_id", "row", F.col("text").alias("part"), "rowspan")


@query("a33_docx_metadata", "SELECT p_partkey, p_brand || '|' || p_type AS authors, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|a|b' ELSE 'x, y|' || p_name END AS words FROM part")
def a33(spark, d):
    even = F.col("p_partkey") % 2 == 0
    core = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_brand", F.lit(" ; "), "p_type", F.lit(";")).alias("creator"), F.when(even, F.col("p_name")).otherwise("x, y;").alias("subject"), F.when(even, F.concat(F.lit("a, b,, "), "p_name")).otherwise(F.col("p_name")).alias("keywords"))
    return docx.package_metadata(core).select("p_partkey", F.array_join("authors", "|").alias("authors"), F.array_join("words", "|").alias("words"))
