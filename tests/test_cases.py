"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.operators import cite, documents, outline, render, template
from leafmill.operators import math as m
from leafmill.sources import citations, html, includes, markdown


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "s string").select(column.alias("v")).first()["v"]


def headings(spark, levels):
    return spark.createDataFrame([(1, i, v) for i, v in enumerate(levels)], "doc_id long, pos long, level int")


@pytest.mark.parametrize(
    "levels,top,want",
    [([1, 2, 3, 2, 1, 2], None, ["1", "1.1", "1.1.1", "1.2", "2", "2.1"]), ([1, 3], None, ["1", "1.0.1"]), ([1, 2, 1], "Chapter", ["Chapter 1", "1.1", "Chapter 2"]), ([2], None, ["0.1"])],
)
def test_number_sections(spark, levels, top, want):
    rows = outline.number_sections(headings(spark, levels), top).orderBy("pos").collect()
    assert [r["number"] for r in rows] == want


def test_ids_take_the_first_free_number(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", "a-1", "a", "b"])], "doc_id long, pos long, slug string")
    assert [r["id"] for r in outline.dedup_ids(rows).orderBy("pos").collect()] == ["a", "a-1", "a-1-1", "a-2", "b"]


def test_contents_leave_out_what_comes_between_levels(spark):
    def kept(levels):
        hs = headings(spark, levels).withColumn("id", F.concat(F.lit("h"), "pos"))
        return [(r["pos"], r["nesting"], r["parent"]) for r in outline.toc_tree(hs).orderBy("pos").collect()]

    assert kept([1, 3, 2, 1]) == [(0, 0, None), (1, 1, 0), (3, 0, None)]
    assert kept([2, 1, 2]) == [(0, 0, None)]
    assert kept([1, 2, 2, 3]) == [(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 2)]


def test_references(spark):
    blocks = spark.createDataFrame([(1, 0, "figure", "a"), (1, 1, "figure", "b"), (1, 2, "code", "c"), (1, 3, "table", "a")], "doc_id long, pos long, kind string, ident string")
    refs = spark.createDataFrame([(1, "b", "number_with_type", None), (1, "a", "number", None), (1, "c", "number_with_type", None), (1, "b", "custom", "see"), (1, "z", "number", None)], "doc_id long, target string, form string, custom_text string")
    got = outline.resolve_crossrefs(refs, outline.label_index(outline.number_labels(blocks))).collect()
    assert sorted((r["target"], r["text"] or "") for r in got) == [("a", "1"), ("b", "Figure 2"), ("b", "see 2"), ("c", "Listing 1"), ("z", "")]


def test_citations_end_to_end(spark):
    bib = '@article{smith, author = {Smith, John}, title = {A Great Paper}, year = 2020, journal = {Nature}, volume = {42}, pages = {1–10}}\n@book{jones, author = "Jones, Alice", title = {Some Book}, publisher = {MIT Press}, year = {2021}}'
    library = citations.read_bibtex(spark.createDataFrame([(1, 1, bib)], "library_id long, ord int, text string")).drop("library_id")
    texts = ["This is notable [@smith].", "Multiple [@smith; @jones].", "As @smith argues", "Year [-@jones].", "With [see @smith, p. 42].", "Unknown [@nonexistent].", "mail a@smith"]
    found = citations.extract_citations(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    said = {r["doc_id"]: r["text"] for r in cite.resolve_citations(found, library, ["doc_id"]).collect()}
    assert said == {0: "(Smith 2020)", 1: "(Smith 2020; Jones 2021)", 2: "Smith (2020)", 3: "2021", 4: "see (Smith 2020), p. 42", 5: "[?nonexistent]"}
    listed = cite.bibliography(found.select(F.lit(1).alias("doc_id"), "key"), library).first()["bibliography"]
    assert listed == "Jones, Alice. 2021. Some Book. MIT Press.\nSmith, John. 2020. “A Great Paper.” Nature 42 : 1–10."


def test_line_ranges(spark):
    assert [tuple(r) for r in one(spark, t.line_ranges(F.lit("2,4-6,10")))] == [(2, 2), (4, 6), (10, 10)]
    assert one(spark, t.line_ranges(F.lit("x,,-3"))) == []


def test_templates(spark):
    docs = spark.createDataFrame([("A", ["x", "y"], {"k": "v"}, True), (None, [], {}, False)], "title string, list array<string>, m map<string,string>, yes boolean")
    said = [r["output"] for r in template.render_template(docs, "[$missing$]$title$|$for(list)$$list$$sep$,$endfor$|$m.k$|$if(yes)$Y$else$N$endif$|$if(title)$t$endif$|$$").collect()]
    assert said == ["[]A|x,y|v|Y|t|$", "[]|||N||$"]


def test_attributes(spark):
    got = one(spark, t.parse_attrs(F.lit('{#i .a .b k=v q="x y"}')))
    assert (got["id"], got["classes"], got["kv"]) == ("i", ["a", "b"], {"k": "v", "q": "x y"})
    assert one(spark, t.parse_attrs(F.lit("{oops}"))) is None and one(spark, t.parse_attrs(F.lit("{}")))["classes"] == []


@pytest.mark.parametrize("text", ["", "\\textbackslash{}", "a\\{b}~^_#$%&", "\\\\~{}"])
def test_latex_escapes_round_trip(spark, text):
    assert one(spark, t.unescape_latex(t.escape_latex(F.col("s"))), text) == text


def test_wrap(spark):
    text = "aa bb cc dd\nee\n\n```\nlong line that stays as it is\n```\n# heading that is long too\nff gg hh\n"
    got = render.wrap_and_eol(spark.createDataFrame([(1, text)], "doc_id long, text string"), 8).first()["text"]
    assert got == "aa bb cc\ndd ee\n\n```\nlong line that stays as it is\n```\n# heading that is long too\nff gg hh\n"


def test_includes(spark):
    files = [(1, "main.tex", "A\\input{./b}C\\begin{verbatim}\\input{b}\\end{verbatim}\\include{no}"), (1, "b.tex", "[\\input{main}\\input{c}]"), (1, "c.ltx", "c")]
    df = spark.createDataFrame(files, "project_id long, path string, text string")
    texts, warnings = includes.resolve_includes(df, df.where("path = 'main.tex'").select("project_id", F.col("path").alias("root")))
    assert texts.first()["text"] == "A[AC\\begin{verbatim}\\input{b}\\end{verbatim}c]C\\begin{verbatim}\\input{b}\\end{verbatim}"
    assert {r["message"] for r in warnings.collect()} == {"\\include{no}: file not found", "circular \\input{./b}"}


def test_open_tags_end_where_they_must():
    blocks = html.parse_page("<h1>T</h1><p><b>one<br><p>two<ul><li>x<li>y</ul><div><p></p></div>tail")
    assert [(b["kind"], b["text"]) for b in blocks if b["text"] is not None] == [("heading", "T"), ("paragraph", "one"), ("paragraph", "two"), ("paragraph", "x"), ("paragraph", "y"), ("paragraph", "tail")]
    assert html.parse_page(None) == []


def test_markdown_blocks(spark):
    text = "# T {#i}\npara\nmore\n> q\nlazy\n\n    code\n| a |\n|---|\n\n```\n# no\n\n```\nend"
    rows = markdown.markdown_blocks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r["kind"], r["text"]) for r in rows] == [("heading", "T"), ("paragraph", "para\nmore"), ("blockquote", "q\nlazy"), ("code", "code"), ("table", "| a |\n|---|"), ("code", "# no\n"), ("paragraph", "end")]


@pytest.mark.parametrize("latex,typst", [(r"\frac{a+b}{2}", "frac(a + b, 2)"), (r"x^{n+1}_i", "x^(n + 1)_i"), (r"\sqrt[3]{x}", "root(3, x)"), (r"\mathbf{v} \foo", "bold(v) foo"), ("", "")])
def test_math(latex, typst):
    assert m.latex_to_typst(latex) == typst


@pytest.mark.parametrize("form", documents.FORMATS)
def test_render_nested_lists(spark, form):
    kinds = ["list", "item"] * 4 + ["paragraph"]
    schema = "doc_id long, pos long, parent long, depth int, kind string, level int, ident string, language string, text string, ordered boolean, start int, index int, checked boolean"
    blocks = spark.createDataFrame([(1, i, i - 1 if i else None, i, k, None, None, None, None, False, None, 0, None) for i, k in enumerate(kinds)], schema)
    inlines = spark.createDataFrame([(1, 8, 0, "text", "deep", None, None)], "doc_id long, pos long, ipos int, kind string, value string, url string, note string")
    text = documents.render_documents(blocks, inlines, form).first()["text"]
    marks = {"html": "<li>", "latex": "\\item"}
    assert "deep" in text and text.count(marks.get(form, "- ")) == 4


def test_a_page_becomes_a_document(spark):
    from leafmill.operators.documents import render_documents
    from leafmill.sources import html

    page = """<!DOCTYPE html><html><head><title>T</title></head><body>
    <h1>Introduction</h1>
    <p>This is a <strong>bold</strong> and <em>italic</em> test.</p>
    <h2 id="code">Code Example</h2>
    <pre><code class="language-python">def hello():
    print("world")</code></pre>
    <blockquote><p>A wise quote.</p></blockquote>
    <ul>
        <li>Item one</li>
        <li>Item two</li>
    </ul>
    <hr>
    <p>A <a href="https://example.com">link</a> and <code>inline code</code>.</p>
    <table><caption>Sizes</caption><thead><tr><th>A</th><th style="text-align: right">B</th></tr></thead><tr><td>1<td colspan=2><b>2</b> x</table>
    <figure id="f"><img src="a.png" alt="pic"><figcaption>A picture</figcaption></figure>
    <ul><li><input type="checkbox" checked> done</li><li><input type="checkbox"> open<ol start="3"><li>deep</li></ol></li></ul></body></html>"""
    want = """# Introduction

This is a **bold** and *italic* test.

## Code Example {#code}

```python
def hello():
    print("world")
```

> A wise quote.

- Item one
- Item two

---

A [link](https://example.com) and `inline code`.

Table: Sizes

| A | B |
| --- | ---: |
| 1 | **2** x |

![A picture](a.png){#f}

- [x] done
- [ ] open

  3. deep
"""
    blocks = html.page_documents(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"))
    assert [tuple(r) for r in render_documents(blocks, None, "markdown").collect()] == [(1, want)]
    found = render_documents(blocks, None, "html").first()["text"]
    assert '<td colspan="2"><p><strong>2</strong> x</p>\n</td>' in found and '<figure id="f"><img src="a.png" alt="pic"><figcaption>A picture</figcaption></figure>' in found and '<ol start="3">' in found
    assert "\\begin{longtable}[]{@{}lr@{}}\n\\caption{Sizes}\\\\\n\\toprule\n\\textbf{A} & \\textbf{B} \\\\\n\\midrule\n1 & \\textbf{2} x \\\\\n" in render_documents(blocks, None, "latex").first()["text"]
    assert "#figure(\n  caption: [Sizes],\n#table(\n  columns: 2,\n  align: (left, right),\n  table.header(\n    [A],\n    [B],\n  ),\n  [1],\n  [*2* x],\n))" in render_documents(blocks, None, "typst").first()["text"]


def test_kinds_of_blocks_and_inlines(spark):
    from leafmill.operators.documents import render_documents

    schema = "doc_id long, pos long, parent long, depth int, kind string, level int, ident string, language string, text string, ordered boolean, start int, index int, checked boolean, title string, classes array<string>, inlines array<struct<kind:string,value:string,url:string,title:string>>"
    row = lambda pos, parent, depth, kind, language=None, text=None, title=None, classes=None, inlines=(): (1, pos, parent, depth, kind, None, None, language, text, None, None, None, None, title, classes, [(*i, None) for i in inlines])
    blocks = spark.createDataFrame([
        row(0, None, 0, "admonition", title="Mind", classes=["warning"]), row(1, 0, 1, "paragraph", inlines=[("quoted", "a", None), ("image", "i", "u.png"), ("citation", "k", None), ("crossref", "x", None), ("raw", "<hr>", "html")]),
        row(2, None, 0, "definition_list"), row(3, 2, 1, "term", inlines=[("text", "T", None)]), row(4, 2, 1, "definition"), row(5, 4, 2, "paragraph", inlines=[("text", "D", None)]), row(6, None, 0, "raw", "html", "<br>"), row(7, None, 0, "raw", "latex", "\\x"),
    ], schema)
    said = {f: render_documents(blocks, None, f).first()["text"] for f in ("html", "markdown")}
    assert said["html"] == '<aside class="admonition warning"><p class="admonition-title">Mind</p><p>&ldquo;a&rdquo;<img src="u.png" alt="i"><cite>k</cite><a href="#x" class="crossref">[x]</a><hr></p>\n</aside>\n<dl>\n<dt>T</dt>\n<dd><p>D</p>\n</dd>\n</dl>\n<br>\n'
    assert said["markdown"].startswith("> [!WARNING] Mind\n> \u201ca\u201d![i](u.png)[@k][x](#x)<hr>\n\nT\n:   D\n\n<br>\n")


def test_fences_and_underscores(spark):
    from leafmill.sources import markdown

    text = "~~~\na\n```\nb\n~~\n~~~~\nafter\n\n````py\n```\nx\n````\nend"
    got = markdown.markdown_blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("pos").collect()
    assert [(r["kind"], r["language"], r["text"]) for r in got] == [("code", None, "a\n```\nb\n~~"), ("paragraph", None, "after"), ("code", "py", "```\nx"), ("paragraph", None, "end")]
    inlines = markdown.markdown_inlines(spark.createDataFrame([(1, "an _em_ and __st__ but snake_case_name")], "doc_id long, text string")).orderBy("ipos").collect()
    assert [(r["kind"], r["value"]) for r in inlines] == [("text", "an "), ("emphasis", "em"), ("text", " and "), ("strong", "st"), ("text", " but snake_case_name")]


def test_style_kinds(spark):
    from leafmill.sources import docx

    cases = {"Subtitle": "normal", "Update": "normal", "Overskrift2": "heading2", "Kap1": "heading1", "Verbatim": "code", "Kop1": "normal", "Title": "title", "Heading7": "heading1", "IntenseQuote": "quote", "My Heading 3": "heading3"}
    rows = spark.createDataFrame(list(cases.items()), "style string, want string")
    got = rows.select("style", "want", docx.style_kind(F.col("style"), F.lit(None).cast("int")).alias("kind")).collect()
    assert {r["style"]: r["kind"] for r in got} == cases


def test_files_in_and_out(spark, tmp_path):
    from leafmill.operators import pipeline

    for name, text in (("a.md", "# A"), ("b.HTML", "<p>b"), ("c.xyz", "?")):
        (tmp_path / name).write_text(text)
    docs = pipeline.read_corpus(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["format"], r["error"]) for r in docs.collect()}
    assert got == {"a.md": ("# A", "markdown", None), "b.HTML": ("<p>b", "html", None), "c.xyz": ("?", None, "unknown format: .xyz")}
    pipeline.write_outputs(docs.where("error IS NULL"), str(tmp_path / "out"))
    assert {r["format"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"markdown", "html"}


def test_markdown_documents(spark):
    from leafmill.operators.documents import render_documents

    text = "1. one\n   - [x] in **b**\n   - [ ] two\n\n     more  \n     hard\n2. last\n\n- a\n* b \\*c\\*\n\n> q\n> - c\n>   - d\n>\n> end\n\ntext\n\n| no table"
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, kind string")
    blocks = markdown.markdown_documents(docs)
    assert blocks.count() == blocks.select("doc_id", "pos").distinct().count()
    want = "1. one\n   \n   - [x] in **b**\n   - two\n     \n     more  \n     hard\n2. last\n\n- a\n\n- b *c*\n\n> q\n>\n> - c\n>   \n>   - d\n>\n> end\n\ntext\n\n| no table\n"
    said = [tuple(r) for r in render_documents(blocks, None, "markdown").collect()]
    assert [(i, "\n".join(line.rstrip() if line.strip(" >") == "" else line for line in s.split("\n"))) for i, s in said] == [(1, "\n".join(line.rstrip() if line.strip(" >") == "" else line for line in want.split("\n")))]


# Inputs with their results as the formats are known to have them.
CONVERSIONS = [
    ("markdown", "html", 'A ***b i***, ~~s~~ & `c`.\n\n[x **y**](u "t") [r] "q" it\'s -- ...\n\n[r]: v', '<p>A <em><strong>b i</strong></em>, <del>s</del> &amp; <code>c</code>.</p>\n<p><a href="u" title="t">x <strong>y</strong></a> <a href="v">r</a> “q” it’s – …</p>\n'),
    ("markdown", "html", "a **b *c* d** [x **y**](u)", '<p>a <strong>b <em>c</em> d</strong> <a href="u">x <strong>y</strong></a></p>\n'),
    ("markdown", "html", "5 * 6 ** _x_y_ *a [b*](u) **", "<p>5 * 6 ** <em>x_y</em> *a <a href=\"u\">b*</a> **</p>\n"),
    ("markdown", "html", "T\n===\n\nU\n---\n# T", '<h1 id="t">T</h1>\n<h2 id="u">U</h2>\n<h1 id="t-1">T</h1>\n'),
    ("markdown", "latex", "| A | *B* |\n|---|:-:|\n| 1 | **2** |", "\\begin{longtable}[]{@{}lc@{}}\n\\toprule\n\\textbf{A} & \\textbf{\\emph{B}} \\\\\n\\midrule\n1 & \\textbf{2} \\\\\n\\bottomrule\n\\end{longtable}\n"),
    ("markdown", "markdown", "[**b** x](u) and *a **b***", "[**b** x](u) and *a **b***\n"),
    ("latex", "html", "\\begin{itemize}\\item a \\begin{itemize}\\item b\\end{itemize}\\item c\\end{itemize} end", "<ul>\n<li><p>a</p>\n<ul>\n<li><p>b</p>\n</li>\n</ul>\n</li>\n<li><p>c</p>\n</li>\n</ul>\n<p>end</p>\n"),
    ("latex", "html", "x\\footnote{n} \\textbf{a \\emph{b}}", '<p>x<sup class="footnote-ref"><a href="#fn-fn1">[fn1]</a></sup> <strong>a <em>b</em></strong></p>\n<aside id="fn-fn1" class="footnote" role="note">\n<p>n</p>\n</aside>\n'),
    ("typst", "html", "*a _b_* #strike[c *d*]\n\n/ T: x", "<p><strong>a <em>b</em></strong> <del>c <strong>d</strong></del></p>\n<dl>\n<dt>T</dt>\n<dd><p>x</p>\n</dd>\n</dl>\n"),
    ("typst", "typst", '#figure(\n  table(columns: 2, [a], [b, (c)]),\n  caption: [C],\n) <t>', "#figure(\n  caption: [C],\n#table(\n  columns: 2,\n  [a],\n  [b, (c)],\n)) <t>\n"),
]


def test_conversions(spark):
    from leafmill.operators.documents import render_documents
    from leafmill.operators.job import readers

    for name in ("markdown", "latex", "typst"):
        own = [(i, c[2]) for i, c in enumerate(CONVERSIONS) if c[0] == name]
        blocks = readers()[name](spark.createDataFrame([*own, (-1, None), (-2, "")], "doc_id long, text string"))
        for form in {c[1] for c in CONVERSIONS if c[0] == name}:
            got = {r["doc_id"]: r["text"] for r in render_documents(blocks, None, form).collect()}
            assert -1 not in got and -2 not in got
            assert {i: got[i] for i, _ in own if CONVERSIONS[i][1] == form} == {i: CONVERSIONS[i][3] for i, _ in own if CONVERSIONS[i][1] == form}


def test_package(spark):
    """A package with a heading, a link, a note, a nested list and a table with merged cells."""
    import io
    import zipfile

    from leafmill.operators.documents import render_documents
    from leafmill.sources import docx

    w, r = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    run = lambda s, pr="": f'<w:r><w:rPr>{pr}</w:rPr><w:t xml:space="preserve">{s}</w:t></w:r>'
    item = lambda n, s: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{n}"/><w:numId w:val="7"/></w:numPr></w:pPr>{run(s)}</w:p>'
    cell = lambda s, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p>{run(s)}</w:p></w:tc>"
    body = f'<w:p><w:pPr><w:pStyle w:val="H"/></w:pPr>{run("T")}</w:p><w:p>{run("a ", "<w:b/>")}{run("b", "<w:b/><w:i/>")}<w:hyperlink r:id="rId1">{run("x ")}{run("y", "<w:i/>")}</w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
    body += item(0, "one") + item(1, "in") + item(0, "two") + f'<w:tbl><w:tr>{cell("A")}{cell("B")}</w:tr><w:tr>{cell("1", "<w:vMerge w:val=\'restart\'/>")}{cell("2")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("3")}</w:tr></w:tbl>'
    parts = {
        "document": f"<w:body>{body}</w:body>", "styles": '<w:style w:styleId="H"><w:name w:val="heading 2"/></w:style>', "footnotes": f'<w:footnote w:id="2"><w:p>{run("note")}</w:p></w:footnote>',
        "numbering": '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="7"><w:abstractNumId w:val="1"/></w:num>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, inner in parts.items():
            z.writestr(f"word/{name}.xml", f'<w:{name} xmlns:w="{w}" xmlns:r="{r}">{inner}</w:{name}>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships><Relationship Id="rId1" Type="{r}/hyperlink" Target="http://u"/></Relationships>')
    blocks = docx.docx_documents(spark.createDataFrame([(1, bytearray(out.getvalue())), (2, bytearray(b"no")), (3, None)], "doc_id long, data binary"))
    want = '<h2>T</h2>\n<p><strong>a <em>b</em></strong><a href="http://u">x <em>y</em></a><sup class="footnote-ref"><a href="#fn-2">[2]</a></sup></p>\n<ol>\n<li><p>one</p>\n<ul>\n<li><p>in</p>\n</li>\n</ul>\n</li>\n<li><p>two</p>\n</li>\n</ol>\n'
    want += '<table>\n<thead>\n<tr><th><p>A</p>\n</th><th><p>B</p>\n</th></tr>\n</thead>\n<tbody>\n<tr><td rowspan="2"><p>1</p>\n</td><td><p>2</p>\n</td></tr>\n<tr><td><p>3</p>\n</td></tr>\n</tbody>\n</table>\n<aside id="fn-2" class="footnote" role="note">\n<p>note</p>\n</aside>\n'
    assert {x["doc_id"]: x["text"] for x in render_documents(blocks.where("kind != 'error'"), None, "html").collect()} == {1: want}
    assert {x["doc_id"] for x in blocks.where("kind = 'error'").collect()} == {2, 3}


YAML = [
    ("a: 1\nb:\n- x\n- 'it''s'\nc: # none\n", '{"a":1,"b":["x","it\'s"],"c":null}'),
    ("a:\n  b: [1, two, {k: v, w: \"x, y\"}]\n  c:\n    - d: true\n      e: u v\n        w\n    - f\n", '{"a":{"b":[1,"two",{"k":"v","w":"x, y"}],"c":[{"d":true,"e":"u v w"},"f"]}}'),
    ("- 1\n- - 2\n  - 3\n- b: -1.5\n", "[1,[2,3],{\"b\":-1.5}]"),
    ("t: |\n  one\n    two\n\n  # three\ng: >-\n  x\n  y\nu: http://h/#a\n", '{"t":"one\\n  two\\n\\n# three\\n","g":"x y\\n","u":"http://h/#a"}'),
    ('k: "q \\" \\n z"\n"a b": 007', '{"k":"q \\" \\n z","a b":"007"}'),
    ("a: 1\na: 2", None), ("", None), (None, None), ("only text", None),
]


def test_yaml(spark):
    from leafmill.functions.yaml import yaml_json

    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(YAML)], "i int, text string")
    got = {r.i: r.j for r in df.select("i", yaml_json(F.col("text")).alias("j")).collect()}
    assert [got[i] for i in range(len(YAML))] == [want for _, want in YAML]


def test_nested_metadata(spark):
    from leafmill.sources.markdown import document_metadata

    docs = [
        (1, "---\nauthors:\n  - name: Ann\n    orcid: '0000'\n  - Bo\ndescription: d\nkeywords: a, b\nx: {y: [1, z]}\n---\nbody ---\nmore"),
        (2, "---\n---\nb"), (3, None), (4, "no ---\nx"), (5, "---\nauthor: {name: X}\ntitle: 2026\n---"),
    ]
    out = document_metadata(spark.createDataFrame(docs, "doc_id int, text string")).withColumn("custom", F.to_json("custom"))
    got = {r.doc_id: r for r in out.collect()}
    assert [tuple(a) for a in got[1].authors] == [("Ann", None, None, "0000"), ("Bo", None, None, None)]
    assert (got[1].abstract, got[1].keywords, got[1].custom, got[1].body) == ("d", ["a", "b"], '{"x":{"y":[1,"z"]}}', "body ---\nmore")
    assert (got[2].body, got[2].title, got[3].body, got[4].body) == ("b", None, "", "no ---\nx")
    assert (got[5].authors, got[5].title, got[5].body) == (None, "2026", "")


def test_tree_of_a_document(spark):
    import json

    from leafmill.operators.tree import tree_json
    from leafmill.sources.markdown import markdown_documents

    text = 'x[^n] ![a](i "t") "q *e*"\n\n---\n\n| A |\n|--:|\n| **b** |\n\n[^n]: > in\n'
    out = tree_json(markdown_documents(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string"))).collect()
    assert [r.doc_id for r in out] == [1]
    first, rule, table, note = json.loads(out[0].json)["content"]
    word = lambda s: {"type": "Text", "value": s}
    assert first["content"][:3] == [word("x"), {"type": "FootnoteRef", "id": "n"}, word(" ")]
    assert {"type": "Image", "url": "i", "title": "t", "alt": [word("a")]} in first["content"]
    assert rule == {"type": "ThematicBreak"}
    assert table["cells"][1] == {"section": "tbody", "row": 0, "col": 0, "align": "right", "content": [{"type": "Strong", "content": [word("b")]}]}
    assert note == {"type": "FootnoteDef", "id": "n", "content": [{"type": "BlockQuote", "content": [{"type": "Paragraph", "content": [word("in")]}]}]}


def test_yaml_library(spark):
    from leafmill.sources.citations import merge_libraries, read_bibtex, read_yaml_library

    text = "# c\nk:\n  type: Article\n  title: {value: T, short: t}\n  author:\n    - name: B\n      given-name: J\n  date: 1997-06\n  parent:\n    - title: M\n      volume: 13\nbad: 1\n'l m':\n  title: U\n"
    rows = [(1, 1, text), (1, 2, "k:\n  title: later\n"), (1, 3, None)]
    lib = read_yaml_library(spark.createDataFrame(rows, "library_id int, ord int, text string"))
    bib = read_bibtex(spark.createDataFrame([(1, 1, "@book{b, title={V}}")], "library_id int, ord int, text string"))
    got = {r.key: (r.entry_type, r.fields) for r in merge_libraries(lib.drop("library_id"), bib.drop("library_id")).collect()}
    assert got == {"k": ("misc", {"title": "later"}), "l m": ("misc", {"title": "U"}), "b": ("book", {"title": "V"})}
    first = read_yaml_library(spark.createDataFrame(rows[:1], "library_id int, ord int, text string")).where("key = 'k'").first()
    assert (first.entry_type, first.fields) == ("article", {"title": "T", "author": "B, J", "year": "1997", "journal": "M", "volume": "13"})


def test_whole_libraries_in_blocks(spark):
    from leafmill.operators import cite

    n = cite.BLOCK * 2 + 1
    lib = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("book").alias("entry_type"), F.create_map(F.lit("author"), F.format_string("A%05d", "id"), F.lit("year"), F.lit("1"), F.lit("title"), F.lit("t")).alias("fields"))
    cited = spark.createDataFrame([(1, "k2"), (1, "k1"), (1, "none")], "doc_id int, key string")
    asked = spark.createDataFrame([(2, "@*"), (2, "@k1"), (3, "@k3")], "doc_id int, key string")
    assert {r.doc_id: r.n for r in cite.nocite_union(cited, asked, lib).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {1: 3, 2: n, 3: 1}
    got = {r.doc_id: r.bibliography.split("\n") for r in cite.bibliography(cited, lib, nocite=asked).collect()}
    assert got[1] == ["A00001. 1. t.", "A00002. 1. t."] and got[3] == ["A00003. 1. t."]
    assert got[2] == [f"A{i:05d}. 1. t." for i in range(n)]
    empty = lib.limit(0)
    assert cite.bibliography(cited, empty, nocite=asked).count() == 0 and cite.nocite_union(cited, asked, empty).where("doc_id = 2").count() == 1


def test_pages_read_only_references_with_a_semicolon():
    blocks = html.parse_page('<h1>A &amp; B &lt;i&gt; &#65;&#x42; &copy &nosuch; and&&amp;&amp</h1><p><a href="x?a=1&copy=2&amp;b=&quot;">c &notit; d</a>')
    assert [b["text"] for b in blocks] == ["A & B <i> AB &copy &nosuch; and&&&amp", "c &notit; d"]
    assert blocks[1]["inlines"][0]["url"] == 'x?a=1&copy=2&b="'


def test_a_whole_library_is_not_shuffled_for_each_document(spark):
    from leafmill.operators import cite

    lib = spark.range(50).select(F.concat(F.lit("k"), F.col("id") % 40).alias("key"), F.lit("book").alias("entry_type"), F.create_map(F.lit("author"), F.lit("A"), F.lit("year"), F.lit("1"), F.lit("title"), F.lit("t")).alias("fields"))
    cited = spark.createDataFrame([(2, "k2"), (2, "none"), (None, "k1")], "doc_id int, key string")
    asked = spark.createDataFrame([(2, "@*"), (2, "@k1"), (3, "@k3"), (3, "@k3")], "doc_id int, key string")
    union = cite.nocite_union(cited, asked, lib)
    got = sorted((r.doc_id or 0, r.key) for r in union.collect())
    assert got == sorted([(2, f"k{i}") for i in range(40)] + [(2, "none"), (3, "k3"), (0, "k1")])
    assert not union._jdf.queryExecution().optimizedPlan().nodeName().startswith("Aggregate")
    plan = cite.bibliography(cited, lib, nocite=asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "_copy" in plan


def test_rows_with_a_whole_library_come_one_by_one(spark):
    from leafmill.operators import cite

    lib = spark.range(50).select(F.concat(F.lit("k"), "id").alias("key"), F.lit("book").alias("entry_type"), F.create_map(F.lit("author"), F.lit("A"), F.lit("year"), F.lit("1"), F.lit("title"), F.lit("t")).alias("fields"))
    cited = spark.createDataFrame([(2, "k2")], "doc_id int, key string")
    asked = spark.createDataFrame([(2, "@*"), (3, "@*")], "doc_id int, key string")
    done = cite.bibliography(cited, lib, nocite=asked)
    assert {r.doc_id: r.bibliography.count("A. 1. t.") for r in done.collect()} == {2: 50, 3: 50}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate explode" not in plan
    union = cite.nocite_union(cited, asked, lib)
    assert union.count() == 100
    # what is exploded by document and block is merged, not sent to the driver
    assert "SortMergeJoin [block" in union._jdf.queryExecution().executedPlan().toString()


def test_pages_are_parsed_in_small_batches():
    import pyarrow as pa

    n = html.PAGES * 2 + 1
    whole = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([f"<p>{i}" for i in range(n - 1)] + [None])], names=["page_id", "html"])
    got = list(html._parsed("page_id", False)(iter([whole])))
    assert [len(b) for b in got] == [html.PAGES, html.PAGES, 1]
    assert [b[0]["text"] if b else None for g in got for b in g.column(1).to_pylist()] == [str(i) for i in range(n - 1)] + [None]


def test_yaml_is_read_once_and_in_many_tasks(spark, small):
    from leafmill.functions.yaml import flow, yaml_json
    from leafmill.jobs import registry

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    texts = spark.createDataFrame([("a: 1",)], "text string")
    assert plan(texts.select(yaml_json(F.col("text")).alias("j"))).count("aggregate(") == 2  # one over the lines, one over what a line says
    assert plan(texts.select(flow(F.col("text")).alias("j"))).count("regexp_extract_all(") == 1
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert registry.QUERIES["c17_nested_metadata"](spark, small).rdd.getNumPartitions() == n
    assert f"Repartition {n}, true" in plan(registry.QUERIES["a34_read_yaml_library"](spark, small))


def test_order_tables_take_one_shuffle(spark, small):
    from leafmill.jobs import registry

    plan = registry.QUERIES["b2_render_html_table"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tables_are_read_once(spark, small):
    from leafmill.jobs import registry

    for name in ("b4_markdown_table", "b7_plaintext_table"):  # before: twice and three times
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution()
        assert plan.optimizedPlan().toString().count("Relation [") == 1
        assert plan.executedPlan().toString().count("Exchange") == 1


def test_tables_with_missing_cells(spark):
    cells = spark.createDataFrame([("thead", 0, 1, "b|", "right"), ("tbody", 0, 0, "x", None), ("tbody", 1, 2, "éé", None), ("tfoot", 0, 0, None, None)], "section string, row int, col int, text string, align string").withColumn("doc_id", F.lit(1))
    assert render.plaintext_table(cells).first()["text"] == "+-----+-----+------+\n|     | b|  |      |\n+-----+-----+------+\n| x   |     |      |\n|     |     | éé |\n+-----+-----+------+\n|     |     |      |\n+-----+-----+------+\n"
    assert render.markdown_table(cells.where("section = 'tbody'")).first()["markdown"] == "|  |  |\n| --- | --- |\n| x |\n| éé |\n"


def test_packages_are_made_in_all_tasks(spark, small):
    from leafmill.jobs import registry

    assert registry.QUERIES["a28_docx_blocks"](spark, small).rdd.getNumPartitions() == 4  # before, that of the file: 1


def test_pieces(spark):
    from leafmill.functions.inlines import pieces
    from leafmill.sources import markdown, typst

    texts = ["", "a", "*a*", "a *b* c", "`x`", "``a`b`` é\n@k.", "me@b.c #link(\"u[\")[t] \\\n_x_", "$a$$b$", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for mark, plain_old in ((typst.MARK, typst.MARK), (typst.TYPST_INLINE, typst.TYPST_INLINE), (markdown.MARK, markdown.MARK)):
        plain, marks = pieces(F.col("text"), mark)
        for r in df.select(plain.alias("p"), marks.alias("m"), F.split("text", plain_old, -1).alias("q"), F.regexp_extract_all("text", F.lit(mark), 0).alias("n")).collect():
            assert r["m"] == r["n"]
            assert r["p"] is None and r["q"] is None or r["p"] in (r["q"], [*r["q"], ""])


def test_inline_queries_use_no_split_by_pattern_and_all_tasks(spark, small):
    from leafmill.jobs.registry import QUERIES

    for name in ("a4_markdown_inlines", "a25_typst_inlines"):
        df = QUERIES[name](spark, small)
        assert df.rdd.getNumPartitions() == 4  # before, that of the file: 1
        assert "split(" not in df._jdf.queryExecution().executedPlan().toString().lower().replace("splitting", "")


def test_texts_without_nesting_are_read_as_by_pairing(spark):
    import random

    rng = random.Random(3)
    bits = ["*", "**", "***", "_", "__", "~", "[", "](u)", '](u "t")', "]", "`", "$", "![", "<http://x>", "http", "http://a.b", "^", "[^n]", "\\", "\\*", " ", "\n", "a", "h", "é", "(", ".", '"', "😀", " **a**", "*b* ", " _c_ ", "[t](u)", "`c`", "$x$", "\x01", "\x02"]
    texts = ["", None, "See **b1**, [t](u)`c*d` 5 * 6 [^n]$x$![a](i)", "\n*ab😀*h", " *a.*b", "*a.* b", "x*a*", "[a *b*](u) *c*"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    read = df.select("text", markdown.inline_array(F.col("text")).alias("a"), markdown.nested_array(F.col("text")).alias("b"))
    assert read.where("NOT (a <=> b)").collect() == []
    # such texts are read without a fold
    flat = spark.range(1).select(markdown.flat_array(F.array(F.lit("See \x02"), F.lit("\x02**b**"), F.lit("\x02[t](u)"))).alias("e")).first().e
    assert [(x.kind, x.value, x.url) for x in flat] == [("text", "See ", None), ("strong", "b", None), ("link", "t", "u")]


def test_latex_tokens_are_dealt_out_once_and_rounds_of_includes_are_tables(spark, monkeypatch):
    from leafmill import tables
    from leafmill.sources import latex

    plans, stored = [], tables.Tables.stored
    monkeypatch.setattr(tables.Tables, "stored", lambda self, df, *parts: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(self, df, *parts))[1])
    body = "a\\begin{foo}x\\begin{foo}y\\end{foo}\\end{foo}\n\n\\begin{itemize}\\item b\\begin{bar}z\\end{bar}\\item c\\end{itemize}\\begin{foo}w\\end{foo}"
    blocks = latex.latex_documents(spark.createDataFrame([(1, body), (2, "\\begin{foo}open"), (3, None)], "doc_id int, text string"))
    raw = {(r.doc_id, r.text) for r in blocks.where("kind = 'raw'").collect()}
    assert raw == {(1, "\\begin{foo}x\\begin{foo}y\\end{foo}\\end{foo}"), (1, "\\begin{bar}z\\end{bar}"), (1, "\\begin{foo}w\\end{foo}"), (2, "\\begin{foo}open")}
    assert max(p.count("Exchange hashpartitioning(doc_id") for p in plans) <= 2  # by document, and what is raw; before, one for each join and window
    files = spark.createDataFrame([(1, "m", "a\\input{x}"), (1, "x.tex", "b")], "project_id int, path string, text string")
    texts, _ = includes.resolve_includes(files, spark.createDataFrame([(1, "m")], "project_id int, root string"))
    assert texts.first()["text"] == "ab"
    assert "ExistingRDD" not in texts._jdf.queryExecution().executedPlan().toString()


def test_typst_texts_without_nesting_are_read_as_by_pairing(spark):
    import random

    from leafmill.sources import typst

    rng = random.Random(5)
    bits = ["*", "_", "~", "[", "]", "`", "$", "#", '#link("u")', '#link("u")[', "#emph[", "#footnote[^n]", '#image("a", alt: "b")', "#cite(<x>)", "#linebreak()", "http://a.b", "h", "@r-1", "\\", "\\\n", "\\*", "\n", " ", "a", "é", ".", "😀", " *ab*", " _b_ ", "`c`", "$x$", "\x01", "\x02"]
    texts = ["", None, 'See @f-1, #link("u")#footnote[^n] *b* 5 * 6', "a *b*c", "[c]"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 10))) for _ in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    read = df.select("text", typst.inline_array(F.col("text")).alias("a"), typst.nested_array(F.col("text")).alias("b"))
    assert read.where("NOT (a <=> b)").collect() == []
