"""Whole documents rendered from their blocks and inlines.

Inlines become one text for each block and blocks one text for each document, by ordered aggregation.
Containers are filled from the inside out: one aggregation for each level of nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.operators.render import html_table, in_order, markdown_table, plaintext_table, section_order
from leafmill.tables import Tables

FORMATS = ("html", "markdown", "myst", "plain", "latex", "typst")
#: LaTeX commands of heading levels.
LATEX_LEVELS = ["section", "subsection", "subsubsection", "paragraph", "subparagraph", "subparagraph"]
#: What stands around inline content, by format and kind.
AROUND = {
    "html": {"small_caps": ('<span style="font-variant: small-caps">', '</span>'), "emphasis": ("<em>", "</em>"), "strong": ("<strong>", "</strong>"), "strikethrough": ("<del>", "</del>"), "superscript": ("<sup>", "</sup>"), "subscript": ("<sub>", "</sub>"), "underline": ("<u>", "</u>")},
    "markdown": {"small_caps": ('[', ']{.smallcaps}'), "emphasis": ("*", "*"), "strong": ("**", "**"), "strikethrough": ("~~", "~~"), "superscript": ("^", "^"), "subscript": ("~", "~"), "underline": ("<u>", "</u>")},
    "myst": {"small_caps": ('[', ']{.smallcaps}'), "emphasis": ("*", "*"), "strong": ("**", "**"), "strikethrough": ("~~", "~~"), "superscript": ("{sup}`", "`"), "subscript": ("{sub}`", "`"), "underline": ("{u}`", "`")},
    "plain": {},
    "latex": {"small_caps": ('\\textsc{', '}'), "emphasis": ("\\emph{", "}"), "strong": ("\\textbf{", "}"), "strikethrough": ("\\sout{", "}"), "superscript": ("\\textsuperscript{", "}"), "subscript": ("\\textsubscript{", "}"), "underline": ("\\underline{", "}")},
    "typst": {"small_caps": ('#smallcaps[', ']'), "emphasis": ("_", "_"), "strong": ("*", "*"), "strikethrough": ("#strike[", "]"), "superscript": ("#super[", "]"), "subscript": ("#sub[", "]"), "underline": ("#underline[", "]")},
}


def escaped(c: Column, form: str) -> Column:
    return {"html": t.escape_html, "latex": t.escape_latex, "typst": t.escape_typst}.get(form, lambda x: x)(c)


def choose(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The first case that holds."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def around_link(form: str, url: Column, title: Column) -> tuple[Column, Column]:
    """What stands before and after the inlines of a link."""
    lit = F.lit
    if form == "html":
        return F.concat(lit('<a href="'), t.escape_attr(url), lit('"'), html_title(title), lit(">")), lit("</a>")
    if form in ("markdown", "myst"):
        return lit("["), F.concat(lit("]("), url, F.coalesce(F.concat(lit(' "'), title, lit('"')), lit("")), lit(")"))
    if form == "plain":
        return lit(""), F.concat(lit(" ("), url, lit(")"))
    if form == "latex":
        return F.concat(lit("\\href{"), url, lit("}{")), lit("}")
    return F.concat(lit('#link("'), t.escape_typst_url(url), lit('")[')), lit("]")


def html_title(title: Column) -> Column:
    return F.coalesce(F.concat(F.lit(' title="'), t.escape_attr(title), F.lit('"')), F.lit(""))


def link(form: str, url: Column, title: Column, said: Column, value: Column) -> Column:
    """A link around one text; where that is the url itself, as formats write it."""
    first, last = around_link(form, url, title)
    whole, same = F.concat(first, said, last), value == url
    if form == "markdown":
        return F.when(same, F.concat(F.lit("<"), url, F.lit(">"))).otherwise(whole)
    if form == "plain":
        return F.when(same | (said == ""), url).otherwise(whole)
    if form == "latex":
        return F.when(same, F.concat(F.lit("\\url{"), url, F.lit("}"))).otherwise(whole)
    return whole


def footnote_ref(form: str, ident: Column, note: Column) -> Column:
    if form == "html":
        return F.concat(F.lit('<sup class="footnote-ref"><a href="#fn-'), ident, F.lit('">['), ident, F.lit("]</a></sup>"))
    if form == "latex":
        return F.concat(F.lit("\\footnotemark["), t.escape_latex(ident), F.lit("]"))
    if form == "typst":
        return F.concat(F.lit("#footnote["), F.coalesce(note, F.lit("")), F.lit("]"))
    return F.concat(F.lit("[^"), ident, F.lit("]"))


def render_inline(form: str, x: Column | None = None, columns: list[str] | None = None) -> Column:
    """The text of an inline event (kind, value, url, title, note): the `columns` of a row, or the fields of x.

    What holds other inlines is two events: its first one, without a value, gives what stands before them, its last
    one (of kind /kind) what stands after.
    """
    missing = ["note"] if columns is None else [c for c in ("title", "note") if c not in columns]
    get = lambda n: F.lit(None).cast("string") if n in missing else F.col(n) if x is None else x[n]
    kind, value, url, title = get("kind"), get("value"), get("url"), get("title")
    said = escaped(value, form)
    code = {"html": F.concat(F.lit("<code>"), said, F.lit("</code>")), "latex": F.concat(F.lit("\\texttt{"), said, F.lit("}")), "plain": value, "typst": F.concat(F.lit("`"), value, F.lit("`"))}.get(form, t.code_span(value))
    math = {"html": F.concat(F.lit('<span class="math math-inline">'), said, F.lit("</span>")), "plain": value}.get(form, F.concat(F.lit("$"), value, F.lit("$")))
    breaks = {"soft": {"plain": " "}.get(form, "\n"), "hard": {"html": "<br>\n", "plain": "\n", "latex": "\\\\\n", "typst": " \\\n"}.get(form, "  \n")}
    cases = [(kind == "text", said)]
    cases += [(kind == k, F.coalesce(F.concat(F.lit(a), said, F.lit(b)), F.lit(a))) for k, (a, b) in (AROUND[form] | quotes(form)).items()]
    cases += [(kind == "code", code), (kind == "math", math), (kind == "link", F.coalesce(link(form, url, title, said, value), around_link(form, url, title)[0])), (kind == "footnote_ref", footnote_ref(form, value, get("note")))]
    cases += [(kind == "soft_break", F.lit(breaks["soft"])), (kind == "hard_break", F.lit(breaks["hard"]))]
    cases += [(kind == k, c) for k, c in references(form, value, url, title, said).items()]
    ends = [(kind == f"/{k}", F.lit(b)) for k, (_, b) in (AROUND[form] | quotes(form)).items()] + [(kind == "/link", around_link(form, url, title)[1])]
    return F.when(F.startswith(kind, F.lit("/")), choose(ends, F.lit(""))).otherwise(choose(cases, F.coalesce(said, F.lit(""))))


def rendered(form: str, inlines: Column | str) -> Column:
    """The text of an array of events; null is empty."""
    return F.coalesce(F.array_join(F.transform(inlines, lambda x: render_inline(form, x)), ""), F.lit(""))


#: Quotation marks by format, double and single; others have them as characters.
QUOTES = {"html": (("&ldquo;", "&rdquo;"), ("&lsquo;", "&rsquo;")), "latex": (("``", "''"), ("`", "'")), "typst": (('"', '"'), ("'", "'"))}


def quotes(form: str) -> dict[str, tuple[str, str]]:
    double, single = QUOTES.get(form, (("\u201c", "\u201d"), ("\u2018", "\u2019")))
    return {"quoted": double, "single_quoted": single}


def references(form: str, value: Column, url: Column, title: Column, said: Column) -> dict[str, Column]:
    """Images (value is the alternative text), citations and cross-references that nothing has resolved, raw pieces (url is their format)."""
    lit, around = F.lit, lambda a, c, b: F.concat(F.lit(a), c, F.lit(b))
    own = lambda f: F.when(url == f, value).otherwise("")
    if form == "html":
        return {"image": F.concat(lit('<img src="'), t.escape_attr(url), lit('" alt="'), t.escape_attr(value), lit('"'), html_title(title), lit(">")), "citation": around("<cite>", value, "</cite>"), "crossref": F.concat(lit('<a href="#'), t.escape_attr(value), lit('" class="crossref">['), said, lit("]</a>")), "raw": own("html")}
    if form == "latex":
        return {"image": around("\\includegraphics{", url, "}"), "citation": around("\\cite{", value, "}"), "crossref": around("\\ref{", value, "}"), "raw": own("latex")}
    if form == "typst":
        return {"image": around('#image("', url, '")'), "citation": around("@", value, ""), "crossref": around("@", value, ""), "raw": own("typst")}
    if form == "plain":
        return {"image": around("[Image: ", value, "]"), "citation": around("[cite: ", value, "]"), "crossref": around("[ref: ", value, "]"), "raw": F.when(url.isin("plain", "text"), value).otherwise("")}
    cite, ref = ("{cite:p}`", "{ref}`") if form == "myst" else (None, None)
    raw = F.when(url == "html", value).otherwise(F.concat(lit("`"), value, lit("`{="), url, lit("}")))
    return {"image": F.concat(lit("!["), value, lit("]("), url, F.coalesce(F.concat(lit(' "'), title, lit('"')), lit("")), lit(")")), "citation": around(cite, value, "`") if cite else around("[@", value, "]"), "crossref": around(ref, value, "`") if ref else F.concat(lit("["), value, lit("](#"), value, lit(")")), "raw": raw}


def strip(c: Column) -> Column:
    """Without white space at both ends, line ends too."""
    return F.regexp_replace(c, r"^\s+|\s+\z", "")


def prefixed(c: Column, first: Column, rest: Column) -> Column:
    """Lines of a text, the first after `first` and others that are not empty after `rest`."""
    return F.concat(first, F.array_join(F.transform(F.split(c, "\n"), lambda line, i: F.when((i > 0) & (line != ""), F.concat(rest, line)).otherwise(line)), "\n"))


def render_block(form: str) -> Column:
    """The text of a block (kind, level, ident, language, text, ordered, start, index, checked, url, title, classes, content).

    content is the inlines of a leaf, the joined blocks of a container or a table made of its cells; index is an
    item's place. A figure has the url and alternative text (text) of its image and its caption as content;
    an admonition its name as first class and its title; a raw block the name of its format as language.
    """
    kind, content, text = F.col("kind"), F.col("content"), F.col("text")
    has = F.col("ident").isNotNull()
    line = F.concat(content, F.lit("\n"))
    lit = F.lit
    ident = F.coalesce("ident", lit(""))
    language = F.coalesce("language", lit(""))
    ended = F.when(F.endswith(text, lit("\n")), text).otherwise(F.concat(text, lit("\n")))
    marker = F.when(F.col("ordered"), F.concat((F.coalesce("start", lit(1)) + F.col("index")).cast("string"), lit(". "))).otherwise("- ")
    box = F.when(F.col("checked"), "[x] ").when(~F.col("checked"), "[ ] ").otherwise("")
    trimmed = F.regexp_replace(content, "\n+$", "")
    table = kind == "table"
    attrs_of = F.concat(F.when(has, F.concat(lit("#"), ident)).otherwise(""), F.array_join(F.transform(F.coalesce("classes", F.array().cast("array<string>")), lambda c, i: F.concat(F.when((i > 0) | has, lit(" .")).otherwise("."), c)), ""))
    named = F.coalesce(F.try_element_at("classes", lit(1)), lit("note"))
    quoted = F.concat(F.array_join(F.transform(F.split(F.regexp_replace(content, "\n\\z", ""), "\n"), lambda x: F.when(x == "", lit(">")).otherwise(F.concat(lit("> "), x))), "\n"), lit("\n"))
    if form == "html":
        tag = F.concat(lit("h"), F.least("level", lit(6)))
        opened = F.when(F.col("ordered"), F.when(F.coalesce("start", lit(1)) != 1, F.concat(lit('<ol start="'), "start", lit('">\n'))).otherwise("<ol>\n")).otherwise("<ul>\n")
        tick = F.when(F.col("checked").isNull(), "<li>").otherwise(F.concat(lit('<li class="task-list-item"><input type="checkbox"'), F.when(F.col("checked"), " checked").otherwise(""), lit(" disabled> ")))
        return choose([
            (kind == "heading", F.concat(lit("<"), tag, F.when(has, F.concat(lit(' id="'), t.escape_attr(ident), lit('"'))).otherwise(""), lit(">"), content, lit("</"), tag, lit(">\n"))),
            (kind == "code", F.concat(lit("<pre><code"), F.when(language != "", F.concat(lit(' class="language-'), t.escape_html(language), lit('"'))).otherwise(""), lit(">"), t.escape_html(text), lit("</code></pre>\n"))),
            (kind == "math", F.concat(lit('<div class="math math-display"'), F.when(has, F.concat(lit(' id="'), t.escape_attr(ident), lit('"'))).otherwise(""), lit(">"), t.escape_html(text), lit("</div>\n"))),
            (kind == "blockquote", F.concat(lit("<blockquote>\n"), content, lit("</blockquote>\n"))),
            (kind == "list", F.concat(opened, content, F.when(F.col("ordered"), "</ol>\n").otherwise("</ul>\n"))),
            (kind == "item", F.concat(tick, content, lit("</li>\n"))),
            (kind == "rule", lit("<hr>\n")),
            (kind == "footnote", F.concat(lit('<aside id="fn-'), ident, lit('" class="footnote" role="note">\n'), content, lit("</aside>\n"))),
            (kind == "div", F.concat(lit("<div"), F.when(has, F.concat(lit(' id="'), t.escape_attr(ident), lit('"'))).otherwise(""), F.when(F.size("classes") > 0, F.concat(lit(' class="'), F.array_join("classes", " "), lit('"'))).otherwise(""), lit(">\n"), content, lit("</div>\n"))),
            (kind == "figure", F.concat(lit("<figure"), F.when(has, F.concat(lit(' id="'), t.escape_attr(ident), lit('"'))).otherwise(""), lit('><img src="'), t.escape_attr(F.coalesce("url", lit(""))), lit('" alt="'), t.escape_attr(F.coalesce(text, lit(""))), lit('">'), F.when(content != "", F.concat(lit("<figcaption>"), content, lit("</figcaption>"))).otherwise(""), lit("</figure>\n"))),
            (kind == "admonition", F.concat(lit('<aside class="admonition '), t.escape_attr(named), lit('">'), F.when(F.col("title").isNotNull(), F.concat(lit('<p class="admonition-title">'), t.escape_html(F.col("title")), lit("</p>"))).otherwise(""), content, lit("</aside>\n"))),
            (kind == "definition_list", F.concat(lit("<dl>\n"), content, lit("</dl>\n"))), (kind == "term", F.concat(lit("<dt>"), content, lit("</dt>\n"))), (kind == "definition", F.concat(lit("<dd>"), content, lit("</dd>\n"))),
            (kind == "raw", F.when(language == "html", F.concat(text, lit("\n"))).otherwise("")), (table, content),
        ], F.concat(lit("<p>"), content, lit("</p>\n")))
    if form in ("markdown", "myst"):
        fence = t.code_fence(text)
        label = F.when(has, F.concat(lit("<!-- label: "), ident, lit(" -->\n"))).otherwise("")
        math = F.concat(lit("$$\n"), strip(text), lit("\n$$\n"), label)
        if form == "myst":
            math = F.concat(lit("```{math}\n"), F.when(has, F.concat(lit(":label: "), ident, lit("\n"))).otherwise(""), strip(text), lit("\n```\n"))
        heading = F.concat(F.repeat(lit("#"), F.col("level")), lit(" "), line)
        attrs = F.concat(F.repeat(lit("#"), F.col("level")), lit(" "), content, F.when(has, F.concat(lit(" {#"), ident, lit("}"))).otherwise(""), lit("\n"))
        return choose([
            (kind == "heading", attrs if form == "markdown" else F.concat(F.when(has, F.concat(lit("("), ident, lit(")=\n"))).otherwise(""), heading)),
            (kind == "code", F.concat(fence, language, lit("\n"), ended, fence, lit("\n"))),
            (kind == "math", math), (kind == "blockquote", quoted), (kind == "list", content),
            (kind == "item", F.concat(prefixed(trimmed, F.concat(marker, box), F.repeat(lit(" "), F.length(marker))), lit("\n"))),
            (kind == "rule", lit("---\n")),
            (kind == "footnote", F.concat(lit("[^"), ident, lit("]: "), strip(content), lit("\n"))),
            (kind == "div", F.concat(lit(":::"), F.when(attrs_of != "", F.concat(lit(" {"), attrs_of, lit("}"))).otherwise(""), lit("\n"), content, lit(":::\n"))),
            (kind == "figure", F.concat(lit("!["), F.when(content != "", content).otherwise(F.coalesce(text, lit(""))), lit("]("), F.coalesce("url", lit("")), lit(")"), F.when(has, F.concat(lit("{#"), ident, lit("}"))).otherwise(""), lit("\n"))),
            (kind == "admonition", F.concat(lit("> [!"), F.upper(named), lit("]"), F.coalesce(F.concat(lit(" "), F.col("title")), lit("")), lit("\n"), quoted) if form == "markdown" else F.concat(lit(":::{"), named, lit("}"), F.coalesce(F.concat(lit(" "), F.col("title")), lit("")), lit("\n"), content, lit(":::\n"))),
            (kind == "definition_list", content), (kind == "term", line), (kind == "definition", F.concat(prefixed(trimmed, lit(":   "), lit("    ")), lit("\n"))),
            (kind == "raw", F.when(language == "html", F.concat(text, lit("\n"))).otherwise(F.concat(lit("```{="), language, lit("}\n"), ended, lit("```\n")))), (table, content),
        ], line)
    if form == "plain":
        under = F.when(F.col("level") == 1, "=").when(F.col("level") == 2, "-")
        underline = F.when(under.isNotNull(), F.concat(F.repeat(under, F.octet_length(content)), lit("\n"))).otherwise("")
        indented = F.array_join(F.transform(F.split(F.regexp_replace(text, "\n\\z", ""), "\n"), lambda x: F.concat(lit("    "), x)), "\n")
        return choose([
            (kind == "heading", F.concat(content, lit("\n"), underline, lit("\n"))), (kind == "code", F.concat(indented, lit("\n\n"))), (kind == "math", F.concat(text, lit("\n\n"))),
            (kind == "blockquote", F.concat(quoted, lit("\n"))), (kind == "list", F.concat(content, lit("\n"))),
            (kind == "item", F.concat(prefixed(trimmed, F.concat(marker, box), F.repeat(lit(" "), F.length(marker))), lit("\n"))),
            (kind == "rule", F.concat(F.repeat(lit("─"), 40), lit("\n\n"))), (kind == "footnote", F.concat(lit("[^"), ident, lit("]: "), strip(content), lit("\n\n"))), (kind == "div", content),
            (kind == "figure", F.concat(lit("[Image: "), F.when(content != "", content).otherwise(F.coalesce(text, lit(""))), lit("]\n\n"))), (kind == "admonition", F.concat(F.upper(F.coalesce("title", named)), lit("\n"), content)),
            (kind == "definition_list", F.concat(content, lit("\n"))), (kind == "term", line), (kind == "definition", F.concat(prefixed(trimmed, lit("    "), lit("    ")), lit("\n"))), (kind == "raw", F.when(language.isin("plain", "text"), F.concat(text, lit("\n\n"))).otherwise("")), (table, F.concat(content, lit("\n"))),
        ], F.concat(content, lit("\n\n")))
    if form == "latex":
        command = F.element_at(F.array(*map(lit, LATEX_LEVELS)), F.least("level", lit(6)))
        env = F.when(F.col("ordered"), "enumerate").otherwise("itemize")
        tick = F.when(F.col("checked"), "[$\\boxtimes$] ").when(~F.col("checked"), "[$\\square$] ").otherwise(" ")
        counter = F.when(F.col("ordered") & (F.coalesce("start", lit(1)) != 1), F.concat(lit("\\setcounter{enumi}{"), F.col("start") - 1, lit("}\n"))).otherwise("")
        label = F.concat(lit("\\label{"), t.escape_label(ident), lit("}"))
        listing = F.concat(lit("\\begin{lstlisting}[language="), language, lit("]\n"), ended, lit("\\end{lstlisting}\n"))
        return choose([
            (kind == "heading", F.concat(lit("\\"), command, lit("{"), content, lit("}"), F.when(has, label).otherwise(""), lit("\n"))),
            (kind == "code", F.when(language != "", listing).otherwise(F.concat(lit("\\begin{verbatim}\n"), ended, lit("\\end{verbatim}\n")))),
            (kind == "math", F.when(has, F.concat(lit("\\begin{equation}\n"), label, lit("\n"), strip(text), lit("\n\\end{equation}\n"))).otherwise(F.concat(lit("\\[\n"), strip(text), lit("\n\\]\n")))),
            (kind == "blockquote", F.concat(lit("\\begin{quote}\n"), content, lit("\\end{quote}\n"))),
            (kind == "list", F.concat(lit("\\begin{"), env, lit("}\n"), F.when(F.col("tight"), "\\tightlist\n").otherwise(""), counter, content, lit("\\end{"), env, lit("}\n"))),
            (kind == "item", F.concat(lit("\\item"), tick, content)), (kind == "rule", lit("\n\\noindent\\rule{\\textwidth}{0.4pt}\n\n")), (kind == "div", content),
            (kind == "footnote", F.concat(lit("\\footnotetext["), ident, lit("]{"), strip(content), lit("}\n"))),
            (kind == "figure", F.concat(lit("\\begin{figure}\n\\centering\n\\includegraphics{"), F.coalesce("url", lit("")), lit("}\n"), F.when(content != "", F.concat(lit("\\caption{"), content, lit("}\n"))).otherwise(""), F.when(has, F.concat(label, lit("\n"))).otherwise(""), lit("\\end{figure}\n"))),
            (kind == "admonition", F.concat(lit("\\begin{quote}\n"), F.coalesce(F.concat(lit("\\textbf{"), t.escape_latex(F.col("title")), lit("}\n\n")), lit("")), content, lit("\\end{quote}\n"))),
            (kind == "definition_list", F.concat(lit("\\begin{description}\n"), content, lit("\\end{description}\n"))), (kind == "term", F.concat(lit("\\item["), content, lit("] "))), (kind == "definition", content),
            (kind == "raw", F.when(language == "latex", F.concat(text, lit("\n"))).otherwise("")), (table, content),
        ], F.concat(content, lit("\n\n")))
    tick = F.when(F.col("checked"), "☑ ").when(~F.col("checked"), "☐ ").otherwise("")
    label = F.when(has, F.concat(lit(" <"), ident, lit(">"))).otherwise("")
    start = F.when(F.col("ordered") & (F.coalesce("start", lit(1)) != 1), F.concat(lit("#set enum(start: "), "start", lit(")\n"))).otherwise("")
    return choose([
        (kind == "heading", F.concat(F.repeat(lit("="), F.col("level")), lit(" "), content, label, lit("\n"))), (kind == "code", F.concat(lit("```"), language, lit("\n"), ended, lit("```\n"))),
        (kind == "math", F.concat(lit("$\n"), strip(text), lit("\n$"), label, lit("\n"))), (kind == "blockquote", F.concat(lit("#quote(block: true)[\n"), content, lit("]\n"))), (kind == "list", F.concat(start, content)),
        (kind == "item", F.concat(F.when(F.col("ordered"), "+ ").otherwise("- "), tick, F.trim(F.regexp_replace(content, "^\n+|\n+$", "")), lit("\n"))), (kind == "rule", lit("#line(length: 100%)\n")), (kind == "footnote", lit("")), (kind == "div", content),
        (kind == "figure", F.concat(lit('#figure(image("'), F.coalesce("url", lit("")), lit('")'), F.when(content != "", F.concat(lit(", caption: ["), content, lit("]"))).otherwise(""), lit(")"), label, lit("\n"))), (kind == "admonition", F.concat(lit("#quote(block: true)[\n"), content, lit("]\n"))),
        (kind == "definition_list", content), (kind == "term", F.concat(lit("/ "), content, lit(": "))), (kind == "definition", F.concat(strip(trimmed), lit("\n"))), (kind == "raw", F.when(language == "typst", F.concat(text, lit("\n"))).otherwise("")), (table, content),
    ], line)


#: What plain text of inlines is used for: kinds that are left out, and what stands for soft and hard breaks.
PLAIN_TEXT = {"alt": (["link", "footnote_ref"], " ", " "), "toc": (["footnote_ref"], " ", "\n"), "slug": (["footnote_ref", "quoted"], " ", " "), "yaml": (["footnote_ref"], " ", " ")}


def inline_text(inlines: DataFrame, use: str) -> DataFrame:
    """(doc_id, pos, text): the plain text of each block's inlines for alternative texts, contents, slugs or YAML."""
    dropped, soft, hard = PLAIN_TEXT[use]
    said = F.when(F.col("kind") == "soft_break", soft).when(F.col("kind") == "hard_break", hard).when(F.col("kind").isin(*dropped), "").otherwise(F.coalesce("value", F.lit("")))
    return inlines.groupBy("doc_id", "pos").agg(in_order("ipos", piece=said).alias("text"))


def numbered_headings(blocks: DataFrame, inlines: DataFrame, top: str | None = None) -> DataFrame:
    """Inlines with the section number and a space before those of each heading."""
    from leafmill.operators.outline import number_sections

    numbers = number_sections(blocks.where("kind = 'heading'").select("doc_id", "pos", "level"), top)
    first = numbers.select("doc_id", "pos", F.lit(-1).alias("ipos"), F.lit("text").alias("kind"), F.concat("number", F.lit(" ")).alias("value"))
    return inlines.unionByName(first, allowMissingColumns=True)


def separator(form: str) -> Column:
    """Between the blocks of a document or container: a blank line where blocks end in one line end; none between items."""
    return F.when(F.col("kind").isin("item", "definition"), "").otherwise("\n" if form in ("markdown", "myst", "typst") else "")


def tables_of(cells: DataFrame, form: str) -> DataFrame:
    """(doc_id, pos, content): each table of cells (doc_id, pos, section, row, col, text, ...) in its format."""
    keyed = cells.withColumn("doc_id", F.struct("doc_id", "pos")).drop("pos")
    inner = rendered(form, "inlines") if "inlines" in cells.columns else escaped(F.col("text"), form)
    keyed = keyed.withColumn("said", F.coalesce(inner, F.lit(""))).drop("inlines")
    if form == "html":
        made = html_table(keyed).withColumnRenamed("html", "content")
    elif form in ("markdown", "myst"):
        made = markdown_table(keyed).withColumnRenamed("markdown", "content")
    elif form == "plain":
        made = plaintext_table(keyed).withColumnRenamed("text", "content")
    else:
        order = F.struct(section_order(F.col("section")).alias("s"), "row")
        columns = F.max("col") + 1
        if form == "latex":
            bold = F.when(F.col("section") == "thead", F.concat(F.lit("\\textbf{"), "said", F.lit("}"))).otherwise(F.col("said"))
            rows = keyed.groupBy("doc_id", order.alias("o")).agg(F.concat(in_order("col", piece=bold, sep=" & "), F.lit(" \\\\\n")).alias("r"))
            ruled = F.when(F.col("o.s") == 0, F.concat("r", F.lit("\\midrule\n"))).when(F.col("o.s") == 2, F.concat(F.lit("\\midrule\n"), "r")).otherwise(F.col("r"))
            spec = keyed.groupBy("doc_id", "col").agg(F.coalesce(F.substring(F.max("align"), 1, 1), F.lit("l")).alias("a")).groupBy("doc_id").agg(in_order("col", piece=F.col("a")).alias("spec"))
            inside = rows.groupBy("doc_id").agg(in_order("o", piece=ruled).alias("rows")).join(spec, "doc_id")
            made = inside.withColumn("content", F.concat(F.lit("\\begin{longtable}[]{@{}"), "spec", F.lit("@{}}\n\\toprule\n"), "rows", F.lit("\\bottomrule\n\\end{longtable}\n")))
        else:
            cell = F.concat(F.when(F.col("o.s") == 1, "  [").otherwise("    ["), "said", F.lit("],\n"))
            parts = keyed.withColumn("o", order).groupBy("doc_id").agg(columns.alias("n"), *[F.coalesce(in_order("o", "col", piece=F.when(F.col("o.s") == i, cell)), F.lit("")).alias(f"p{i}") for i in range(3)])
            sides = keyed.groupBy("doc_id", "col").agg(F.coalesce(F.max("align"), F.lit("left")).alias("a")).groupBy("doc_id").agg(F.when(F.bool_or(F.col("a") != "left"), F.concat(F.lit("  align: ("), in_order("col", piece=F.col("a"), sep=", "), F.lit("),\n"))).otherwise("").alias("align"))
            held = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"  table.{name}(\n"), c, F.lit("  ),\n"))).otherwise("")
            made = parts.join(sides, "doc_id").withColumn("content", F.concat(F.lit("#table(\n  columns: "), "n", F.lit(",\n"), "align", held("header", "p0"), "p1", held("footer", "p2"), F.lit(")\n")))
    return made.select("doc_id.doc_id", "doc_id.pos", "content")


def captioned(form: str, table: Column, caption: Column, ident: Column) -> Column:
    """A table with its caption (rendered, empty if there is none) and label."""
    lit, has, said = F.lit, ident.isNotNull(), caption != ""
    if form == "html":
        opened = F.concat(lit("<table"), F.when(has, F.concat(lit(' id="'), t.escape_attr(ident), lit('"'))).otherwise(""), lit(">\n"), F.when(said, F.concat(lit("<caption>"), caption, lit("</caption>\n"))).otherwise(""))
        return F.concat(opened, F.expr("substr(made, 9)"))
    if form in ("markdown", "myst"):
        return F.concat(F.when(said, F.concat(lit("Table: "), caption, lit("\n\n"))).otherwise(""), table)
    if form == "latex":
        label = F.when(has, F.concat(lit("\\label{"), t.escape_label(ident), lit("}"))).otherwise("")
        line = F.concat(F.when(said, F.concat(lit("\\caption{"), caption, lit("}"))).otherwise(""), label, lit("\\\\\n"))
        first = F.instr(table, "\n")
        return F.when(has | said, F.concat(F.substring(table, lit(1), first), line, F.substring(table, first + 1, F.length(table)))).otherwise(table)
    if form == "typst":
        label = F.when(has, F.concat(lit(" <"), ident, lit(">"))).otherwise("")
        inside = F.concat(lit("#figure(\n"), F.when(said, F.concat(lit("  caption: ["), caption, lit("],\n"))).otherwise(""), F.regexp_replace(table, "\n\\z", ""), lit(")"), label, lit("\n"))
        return F.when(has | said, inside).otherwise(table)
    return table


def from_deepest(rows: DataFrame, block: Column, sep: Column) -> DataFrame:
    """(doc_id, text): blocks (doc_id, pos, parent, depth, content, ...) as `block` writes them, each with `sep` before it if it is not the first.

    From the deepest level up, what stands in a container becomes its content. The rows are written once, in a
    folder for each depth: each step reads its own blocks only.
    """
    rows = Tables(rows).stored(rows, "depth")
    level, depth = None, rows.agg(F.max("depth")).first()[0] or 0
    for d in range(depth, -1, -1):
        here = rows.where(F.col("depth") == d)
        if level is not None:
            here = here.join(level, ["doc_id", "pos"], "left").withColumn("content", F.coalesce("inner", "content")).drop("inner")
        said = here.select("doc_id", "pos", "parent", sep.alias("sep"), block.alias("s"))
        keys = ["doc_id"] if d == 0 else ["doc_id", "parent"]
        ordered = F.array_sort(F.collect_list(F.struct("pos", "sep", "s")))
        joined = F.array_join(F.transform(ordered, lambda x, i: F.concat(F.when(i > 0, x["sep"]).otherwise(""), x["s"])), "")
        level = said.groupBy(*keys).agg(joined.alias("inner")).withColumnRenamed("parent", "pos")
    return level.withColumnRenamed("inner", "text")


def render_documents(blocks: DataFrame, inlines: DataFrame | None, form: str) -> DataFrame:
    """(doc_id, text) of blocks (doc_id, pos, parent, depth, ...) and inlines (doc_id, pos, ipos, kind, value, url, note).

    Without `inlines`, blocks have them as arrays in their column inlines; tables have their cells in a column cells, if
    there is one. parent is the pos of the container,
    index the place of an item in its list.
    """
    for name, kind in (("url", "string"), ("title", "string"), ("classes", "array<string>"), ("tight", "boolean")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    if inlines is None:
        rows = blocks.withColumn("content", rendered(form, "inlines"))
    else:
        content = inlines.groupBy("doc_id", "pos").agg(in_order("ipos", piece=render_inline(form, columns=inlines.columns)).alias("content"))
        rows = blocks.join(content, ["doc_id", "pos"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    if "cells" in blocks.columns:
        cells = blocks.where("kind = 'table'").select("doc_id", "pos", F.inline("cells"))
        rows = rows.join(tables_of(cells, form).withColumnRenamed("content", "made"), ["doc_id", "pos"], "left").withColumn("content", F.when(F.col("made").isNotNull(), captioned(form, F.col("made"), F.col("content"), F.col("ident"))).otherwise(F.col("content"))).drop("made")
    fields = ["doc_id", "pos", "parent", "depth", "kind", "level", "ident", "language", "text", "ordered", "start", "index", "checked", "url", "title", "classes", "tight", "content"]
    out = from_deepest(rows.select(*fields), render_block(form), separator(form))
    return out.withColumn("text", F.concat(F.regexp_replace("text", "^[\\s]+|[\\s]+$", ""), F.lit("\n"))) if form == "plain" else out


def resolved(blocks: DataFrame, inlines: DataFrame) -> DataFrame:
    """Inlines with the text of each cross-reference (value is its label) that a block of its document answers; others stay."""
    from leafmill.operators.outline import label_index, number_labels, resolve_crossrefs

    refs = inlines.where("kind = 'crossref'").select("doc_id", "pos", "ipos", F.col("value").alias("target"), F.lit("number_with_type").alias("form"), F.lit(None).cast("string").alias("custom_text"))
    labelled = blocks.withColumn("kind", F.when(F.col("kind") == "math", "equation").otherwise(F.col("kind")))
    found = resolve_crossrefs(refs, label_index(number_labels(labelled))).select("doc_id", "pos", "ipos", F.col("text").alias("found")).where("found IS NOT NULL")
    joined = inlines.join(found, ["doc_id", "pos", "ipos"], "left")
    known = F.col("found").isNotNull()
    return joined.withColumns({"kind": F.when(known, "text").otherwise(F.col("kind")), "value": F.when(known, F.col("found")).otherwise(F.col("value"))}).drop("found")
