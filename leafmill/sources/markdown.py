"""Markdown read by lines and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.sources.notes import NOTES


def pipe_table_cells(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells (key, row, col, text, align) of one pipe table for each row (key, text); row 0 is the head.

    The second line sets the alignments and the number of columns; short rows are filled, long ones cut.
    """
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    lines = tables.withColumn("_lines", F.split("text", "\n"))
    rule = F.transform(cells(F.element_at("_lines", 2)), lambda c: F.when(c.rlike("^:-+:$"), "center").when(c.rlike("-:$"), "right").when(c.rlike("^:"), "left").otherwise("default"))
    rows = lines.select(key, rule.alias("_rule"), F.posexplode("_lines").alias("_n", "_line")).where("_n != 1")
    wide = rows.select(key, F.when(F.col("_n") == 0, 0).otherwise(F.col("_n") - 1).alias("row"), "_rule", cells(F.col("_line")).alias("_cells"))
    each = wide.select(key, "row", "_cells", F.posexplode("_rule").alias("col", "align"))
    return each.select(key, "row", "col", F.coalesce(F.try_element_at("_cells", F.col("col") + 1), F.lit("")).alias("text"), "align")


# ---- Blocks by lines --------------------------------------------------------------------------------

#: What a line outside of code is, by its beginning; the first that fits.
LINE_KINDS = [
    ("blank", r"^\s*$"), ("heading", r"^#{1,6}(\s|$)"), ("rule", r"^ {0,3}([-*_])(\s*\1){2,}\s*$"), ("blockquote", r"^ {0,3}>"), ("footnote", r"^\[\^[^\]]+\]:"), ("link_definition", r"^ {0,3}\[(?!\^)[^\[\]]+\]:\s*\S+"),
    ("list", r"^ {0,3}([-*+]|[0-9]{1,9}[.)])\s"), ("table", r"^ {0,3}\|"), ("math", r"^\$\$"), ("indented", r"^(    |\t)"),
]


def fences(bars: Column) -> Column:
    """Of the lines that look like fences (n, bar, bare), in order, those that open or close code: a fence is closed by one of its sign that is no shorter."""
    none = F.lit(None).cast("string")
    begin = F.struct(none.alias("open"), F.array().cast("array<struct<n:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        closes = (F.substring(x["bar"], 1, 1) == F.substring(a["open"], 1, 1)) & (F.length(x["bar"]) >= F.length(a["open"])) & x["bare"]
        more = F.concat(a["out"], F.array(F.struct(x["n"].alias("n"))))
        return F.when(a["open"].isNull(), F.struct(x["bar"].alias("open"), more.alias("out"))).when(closes, F.struct(none.alias("open"), more.alias("out"))).otherwise(a)

    return F.aggregate(bars, begin, step, lambda a: a["out"])


def markdown_blocks(docs: DataFrame, key: str = "doc_id", whole_lists: bool = False) -> DataFrame:
    """Top-level blocks (key, pos, kind, level, ident, language, text) of Markdown documents (key, text).

    One window over a document's lines finds which lie in fences or display math, another where runs of
    lines of one kind begin. Headings, rules and footnotes are a line and what continues it; other blocks are
    runs. With whole_lists a list is one block with all that is indented under it, also after blank lines, until
    its sign changes; without, a blank line ends it. Text is the block's own, without markers; list markers stay.
    pos is the first line.
    """
    from pyspark.sql import Window

    from leafmill.functions.text import code_info, trailing_attrs

    w = Window.partitionBy(key).orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("n", "line"))
    fence, math = F.col("line").rlike(r"^ {0,3}(```|~~~)"), F.col("line").rlike(r"^\$\$\s*$")
    odd = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0)) % 2 == 1
    bars = lines.where(fence).select(key, "n", F.regexp_extract("line", r"^ {0,3}(`{3,}|~{3,})(.*)$", 1).alias("bar"), (F.trim(F.regexp_extract("line", r"^ {0,3}(`{3,}|~{3,})(.*)$", 2)) == "").alias("bare"))
    real = bars.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "bar", "bare"))).alias("bars")).select(key, F.inline(fences(F.col("bars")))).withColumn("fence", F.lit(True))
    marked = lines.join(real, [key, "n"], "left").withColumn("fence", F.coalesce("fence", F.lit(False)))
    marked = marked.withColumn("in_code", odd(F.col("fence"))).withColumn("bar", math & ~F.col("in_code") & ~F.col("fence")).withColumn("in_math", odd(F.col("bar")))
    kind = F.when(F.col("fence") | F.col("in_code"), "code").when(F.col("bar") | F.col("in_math"), "math")
    for name, pattern in LINE_KINDS:
        kind = kind.when(F.col("line").rlike(pattern), name)
    k = marked.withColumn("kind", kind.otherwise("paragraph")).withColumn("last", F.lag("kind", 1, "blank").over(w))
    # A list goes on over blank and indented lines, and over a line of text right after one of its own.
    goes_on = F.col("kind").isin("list", "blank") | F.col("line").rlike(r"^(\s{2,}|\t|\s*$)") | ((F.col("kind") == "paragraph") & (F.col("last") != "blank"))
    latest = lambda c: F.coalesce(F.max(F.when(c, F.col("n"))).over(upto), F.lit(-1))
    k = k.withColumn("listed", (latest(F.col("kind") == "list") > latest(~goes_on)) & (F.col("kind") != "rule") if whole_lists else F.lit(False))
    # A line of = or - under a line of text makes it a heading.
    ruled = ((F.col("kind") == "paragraph") & F.col("line").rlike(r"^ {0,3}=+\s*$")) | (F.col("kind").isin("rule", "paragraph") & F.col("line").rlike(r"^ {0,3}-+\s*$"))
    k = k.withColumn("underline", ruled & (F.col("last") == "paragraph") & ~F.col("listed")).withColumn("kind", F.when(F.col("underline"), "paragraph").otherwise(F.col("kind")))
    marker = F.when(F.col("listed") & (F.col("kind") == "list"), F.nullif(F.regexp_extract("line", r"^ ?(?:[0-9]{1,9})?([-*+.)])\s", 1), F.lit("")))
    k = k.withColumn("marker", marker).withColumn("marked", F.last("marker", True).over(before))
    k = k.withColumn("kind", F.when(F.col("listed"), "list").otherwise(F.col("kind"))).withColumn("last", F.lag("kind", 1, "blank").over(w))
    lazy = ((F.col("kind") == "paragraph") & F.col("last").isin("blockquote", "list", "footnote")) | ((F.col("kind") == "indented") & F.col("last").isin("paragraph", "list", "footnote"))
    if whole_lists:
        lazy = lazy & (F.col("last") != "list")
    opens = (F.col("fence") & ~F.col("in_code")) | (F.col("bar") & ~F.col("in_math"))
    inside = F.col("in_code") | F.col("in_math")
    new = F.when(F.col("listed"), (F.col("last") != "list") | F.coalesce(F.col("marker") != F.col("marked"), F.lit(False))).when(inside, False)
    new = new.otherwise(opens | F.lag("underline", 1, False).over(w) | F.col("kind").isin("heading", "rule", "footnote", "link_definition") | ((F.col("kind") != F.col("last")) & ~lazy) | ((F.col("kind") == "code") & ~inside))
    runs = k.withColumn("block", F.sum(new.cast("int")).over(upto))
    own = F.when(F.col("listed"), F.col("line")).when((F.col("kind") == "code") & F.col("fence"), None).when(F.col("bar"), None).otherwise(F.col("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", own.alias("s")))), lambda s: s["s"])
    grouped = runs.groupBy(key, "block").agg(F.min("n").alias("pos"), F.min_by("kind", "n").alias("kind"), F.min_by("line", "n").alias("first"), F.array_compact(ordered).alias("ls"), F.bool_or("underline").alias("underlined"), F.min_by((F.col("last") == "blank") & (F.col("n") > 0), "n").alias("spaced"), F.count(F.when(F.col("kind") == "blank", 1)).alias("blanks")).where("kind != 'blank'")
    under = (F.col("kind") == "paragraph") & F.coalesce("underlined", F.lit(False)) & (F.size("ls") > 1)
    level = F.when(F.trim(F.try_element_at("ls", F.lit(-1))).startswith("="), 1).otherwise(2)
    grouped = grouped.withColumns({"setext": F.when(under, level), "kind": F.when(under, "heading").otherwise(F.col("kind")), "ls": F.when(under, F.slice("ls", F.lit(1), F.size("ls") - 1)).otherwise(F.col("ls"))})
    body = F.filter("ls", lambda s: (F.trim(s) != "") | F.col("kind").isin("code", "math", "list"))
    unquoted = F.transform(body, lambda s: F.regexp_replace(s, r"^ {0,3}> ?", ""))
    dedented = F.transform(body, lambda s: F.regexp_replace(s, r"^(    |\t)", ""))
    joined = F.array_join(F.when(F.col("kind") == "blockquote", unquoted).when(F.col("kind") == "indented", dedented).otherwise(body), "\n")
    title = F.when(F.col("setext").isNotNull(), joined).otherwise(F.regexp_replace(F.regexp_replace("first", r"^#+\s*", ""), r"\s+#+\s*$", ""))
    head = trailing_attrs(F.trim(title))
    text = F.when(F.col("kind") == "heading", head["text"]).when(F.col("kind") == "footnote", F.regexp_replace(joined, r"^\[\^[^\]]+\]:\s*", "")).when(F.col("kind") == "rule", "").when(F.col("kind") == "math", F.trim(joined)).when(F.col("kind") == "list", F.regexp_replace(joined, r"\s+$", "")).otherwise(joined)
    info = code_info(F.regexp_replace("first", r"^ {0,3}[`~]+", ""))
    return grouped.select(
        key, "pos", F.when(F.col("kind") == "indented", "code").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "heading", F.coalesce("setext", F.length(F.regexp_extract("first", "^#+", 0)))).alias("level"),
        F.when(F.col("kind") == "heading", head["attrs"]["id"]).when(F.col("kind") == "footnote", F.regexp_extract("first", r"^\[\^([^\]]+)\]", 1)).alias("ident"),
        F.when(F.col("kind") == "code", info["language"]).alias("language"), text.alias("text"), *(["spaced"] if whole_lists else []),
    )


#: What is not plain text: code, math, images, note references, links written out, escapes, ends and beginnings of links, runs of marks, superscript. Places without a sign that may begin it are passed over at once.
MARK = (
    r"(?s)(?=[`$!\[\]<h\\*_~^])(?:(?<ticks>`+)(?!`).+?(?<!`)\k<ticks>(?!`)|\$[^$\s](?:[^$]*[^$\s])?\$|!\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\]\([^()\s]*(?:\s+\"[^\"]*\")?\s*\)|\[\^[^\]\s]+\]|<(?:https?|mailto):[^<>\s]+>|(?<![\w/])https?://[^\s<>\[\]()*]*[^\s<>\[\]()*.,;:!?\"'_~]"
    r"|\\[!-/:-@\[-`{-~]|\[(?=(?:[^\[\]]++|\[[^\[\]]*+\])*+\]\([^()\s]*(?:\s+\"[^\"]*\")?\s*\))|\]\([^()\s]*(?:\s+\"[^\"]*\")?\s*\)|(?<=[^\s*])\*+|(?<!\*)\*+(?=[^\s*])|(?<![\p{L}\p{N}_])_+(?=[^\s_])|(?<=[^\s_])_+(?![\p{L}\p{N}_])|~~?|\^[^\^\s]+\^)"
)


#: Plain text in which no mark can begin.
INSIDE = r"(?:[^`$!\[\]<\\*_~^h]|h(?!ttps?://))"
#: Marks around plain text that only pair with each other, with that text: the first stands after a space, so it cannot close; the last can close, and nothing between them answers either.
SPANS = "|".join(
    rf"(?<!\S){sign}(?=\S){INSIDE}++(?<!\s)(?:{after})"
    for sign, after in (
        *[(star, rf"(?<![\p{{P}}\p{{S}}\p{{Cs}}]){star}(?!\*)|(?<=[\p{{P}}\p{{S}}]){star}(?!\*)(?=[\s\p{{P}}\p{{S}}]|\z)") for star in (r"\*", r"\*\*")],
        *[(line, rf"{line}(?!_)(?=[\s\p{{P}}\p{{S}}]|\z)") for line in ("_", "__")],
    )
)
SPANS += rf"|\[{INSIDE}++\]\([^()\s]*(?:\s+\"[^\"]*\")?\s*\)"
#: Group 1: all before the next span or mark, with escaped signs; group 3: a span or mark (2 is the fence of code).
TOKEN = rf"((?:[^`$!\[\]<h\\*_~^]++|h(?!ttps?://)|\\[!-/:-@\[-`{{-~]|(?!{SPANS}|{MARK.replace('ticks', 'fence')})(?s:.))++)|({SPANS}|{MARK})"
#: A token that has to be paired.
OPEN = r"\A\x02(?:(?:\*+|_+|~+|\[)\z|\]\()"
#: What stands behind the text of a link or an image.
TARGET = r'\]\(([^()\s]*)(?:\s+"([^"]*)")?\s*\)$'


def inline_array(text: Column, smart: bool = False) -> Column:
    """Events (kind, value, url, title) of a text: markup nests, marks are paired as `paired` says, an escaped sign is text.

    With `smart`, quotes, dashes and dots in plain text become typographic ones. Most texts have nothing but spans and
    marks that stand for themselves; only others go through the pairing.
    """
    from leafmill.functions.inlines import event, let, readable, tokens
    from leafmill.functions.inlines import smart as smarter
    from leafmill.sources.html import unescape

    events = let(tokens(text, TOKEN, 3), lambda ts: F.when(readable(text, ts, OPEN), flat_array(ts)).otherwise(nested_array(text)))
    prose = lambda e: e["kind"].isin("text", "emphasis", "strong", "strikethrough", "superscript", "subscript") | ((e["kind"] == "link") & (e["value"] != e["url"]))
    typed = lambda e, i: F.when(prose(e) & e["value"].isNotNull(), event(e["kind"], smarter(unescape(e["value"]), (i == 0) | (e["kind"] != "text")), e["url"], e["title"])).otherwise(e)
    return F.transform(events, typed) if smart else events


def between(c: Column, a: int, z: int) -> Column:
    """A text from its character a on, without the last z."""
    return F.substring(c, F.lit(a), F.length(c) - (a - 1 + z))


def code_text(m: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(m, "^`+|`+$", ""), r"(?s)^ (?=.*\S)(.*) $", "$1")


def target_of(m: Column) -> tuple[Column, Column]:
    """url and title of a link or an image."""
    return F.regexp_extract(m, TARGET, 1), F.nullif(F.regexp_extract(m, TARGET, 2), F.lit(""))


def flat_array(tokens: Column) -> Column:
    """Events of tokens of which none has to be paired: marks begin with \\x02, all else ends with it."""
    from leafmill.functions.inlines import event

    lit = F.lit
    text = lambda p: F.when(F.contains(p, lit("\\")), F.regexp_replace(p, r"\\([!-/:-@\[-`{-~])", "$1")).otherwise(p)

    def one(t: Column) -> Column:
        sign, m = F.substring(t, 2, 1), between(t, 2, 0)
        doubled = F.substring(t, 3, 1).isin("*", "_")
        return (
            F.when(~F.startswith(t, lit("\x02")), event(lit("text"), text(between(t, 1, 1))))
            .when(sign == "`", event(lit("code"), code_text(m)))
            .when(sign == "$", event(lit("math"), between(t, 3, 1)))
            .when(F.startswith(t, lit("\x02[^")), event(lit("footnote_ref"), between(t, 4, 1)))
            .when(sign == "[", event(lit("link"), F.regexp_extract(m, r"^\[([^\]]*)\]", 1), *target_of(m)))
            .when(sign.isin("*", "_"), event(F.when(doubled, "strong").otherwise("emphasis"), F.when(doubled, between(t, 4, 2)).otherwise(between(t, 3, 1))))
            .when(sign == "!", event(lit("image"), F.regexp_extract(m, r"(?s)^!\[(.*)\]\(", 1), *target_of(m)))
            .when(sign == "<", event(lit("link"), between(t, 3, 1), between(t, 3, 1)))
            .when(sign == "h", event(lit("link"), m, m))
            .otherwise(event(lit("superscript"), between(t, 3, 1)))
        )

    return F.transform(tokens, one)


def nested_array(text: Column) -> Column:
    """Events of any text, by pairing its marks."""
    from leafmill.functions.inlines import event, let, paired, pieces, token

    lit, space, punct = F.lit, lambda c: c.rlike(r"^\s*$"), lambda c: c.rlike(r"^[\p{P}\p{S}]$")
    rest = lambda c, n: F.substring(c, n, 1 << 30)
    none = F.array().cast("array<struct<kind:string,value:string,url:string,title:string,sign:string,opens:boolean,closes:boolean>>")

    def mark(m: Column, before: Column, after: Column) -> Column:
        sign = F.substring(m, 1, 1)
        left = ~space(after) & (~punct(after) | space(before) | punct(before))
        right = ~space(before) & (~punct(before) | space(after) | punct(after))
        opens = F.when(sign == "_", left & (~right | punct(before))).otherwise(left)
        closes = F.when(sign == "_", right & (~left | punct(after))).otherwise(right)
        unit = lambda kind, value, s: token(kind, value, None, None, s, opens, closes)
        autolink = between(m, 2, 1)
        return (
            F.when(sign == "`", F.array(token(lit("code"), code_text(m))))
            .when(sign == "$", F.array(token(lit("math"), between(m, 2, 1))))
            .when(sign == "!", F.array(token(lit("image"), F.regexp_extract(m, r"(?s)^!\[(.*)\]\(", 1), *target_of(m))))
            .when(F.startswith(m, lit("[^")), F.array(token(lit("footnote_ref"), between(m, 3, 1))))
            .when(sign == "<", F.array(token(lit("link"), autolink, autolink)))
            .when(sign == "h", F.array(token(lit("link"), m, m)))
            .when(sign == "\\", F.array(token(lit("text"), rest(m, 2))))
            .when(sign == "[", F.array(token(null("string"), m, None, None, sign, lit(True), lit(False))))
            .when(sign == "]", F.array(token(lit("link"), m, *target_of(m), lit("["), lit(False), lit(True))))
            .when(sign == "^", F.array(token(lit("superscript"), between(m, 2, 1))))
            .when(sign == "~", F.array(unit(F.when(m == "~", "subscript").otherwise("strikethrough"), m, m)))
            .otherwise(F.array_repeat(unit(null("string"), sign, sign), F.length(m)))
        )

    def tokens(plain: Column, marks: Column) -> Column:
        edge = lambda c, n: F.substring(c, n, 1)
        beside = lambda near, far, n: F.when(near != "", edge(near, n)).otherwise(F.coalesce(edge(far, n), lit(" ")))
        said = lambda p: F.when(p != "", F.array(token(lit("text"), p))).otherwise(none)
        each = F.transform(plain, lambda p, i: F.concat(said(p), F.when(i < F.size(marks), mark(F.get(marks, i), beside(p, F.get(marks, i - 1), -1), beside(F.get(plain, i + 1), F.get(marks, i + 1), 1))).otherwise(none)))
        return F.flatten(each)

    def parsed(plain: Column) -> Column:
        return let(found, lambda marks: F.when(F.size(marks) == 0, F.transform(F.filter(plain, lambda p: p != ""), lambda p: event(lit("text"), p))).otherwise(paired(tokens(plain, marks))))

    pieces_of, found = pieces(text, MARK)
    return let(pieces_of, parsed)


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def markdown_inlines(blocks: DataFrame) -> DataFrame:
    """Inlines (keys of blocks, ipos, kind, value, url) of the column text."""
    keys = [c for c in blocks.columns if c != "text"]
    return blocks.select(*keys, F.posexplode(inline_array(F.col("text"))).alias("ipos", "x")).select(*keys, "ipos", "x.kind", "x.value", "x.url")


def with_breaks(inlines: Column) -> Column:
    """Inlines with a soft break for each line break in their texts, a hard one after two spaces or a backslash."""
    from leafmill.functions.inlines import event as inline
    from leafmill.functions.inlines import let

    def split(x):
        parts = F.split(x["value"], "\n", -1)
        hard = lambda p: F.coalesce(p.rlike(r"(  +|\\\\)$"), F.lit(False))
        said = lambda p, i: inline(F.lit("text"), F.when(i < F.size(parts) - 1, F.regexp_replace(p, r"( +|\\\\)$", "")).otherwise(p))
        each = F.transform(parts, lambda p, i: F.array(inline(F.when(hard(F.get(parts, i - 1)), "hard_break").otherwise("soft_break"), F.when(i > 0, "\n").otherwise("")), said(p, i)))
        return F.filter(F.flatten(each), lambda y: y["value"] != "")

    broken = lambda x: (x["kind"] == "text") & F.contains(x["value"], F.lit("\n"))
    return let(inlines, lambda xs: F.when(F.exists(xs, broken), F.flatten(F.transform(xs, lambda x: F.when(broken(x), split(x)).otherwise(F.array(x))))).otherwise(xs))


# ---- Whole documents --------------------------------------------------------------------------------

#: What a place is worth: pos is the line times this plus the depth.
PLACES = 4096


def list_items(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Items (keys, line, index, ordered, start, checked, text, spaced) of one list for each row (keys, text).

    An item begins at a marker that stands no more than one place right of the list's first; what follows is
    taken back by the width of the marker. line is that of the marker, from 0; lists number items from start.
    spaced items have a blank line before them.
    """
    from pyspark.sql import Window

    mark = r"^ *(?:[-*+]|[0-9]{1,9}[.)])(?: {1,4}|$)"
    w = Window.partitionBy(*keys).orderBy("n")
    spaces = lambda c: F.length(F.regexp_extract(c, "^ *", 0))
    text = F.replace("text", F.lit("\t"), F.lit("    "))
    number = F.regexp_extract(text, r"^ *([0-9]{1,9})[.)]", 1)
    lines = lists.select(*keys, spaces(text).alias("base"), (number != "").alias("ordered"), F.nullif(number, F.lit("")).cast("int").alias("start"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    begins = F.col("line").rlike(mark) & (spaces(F.col("line")) <= F.col("base") + 1)
    x = lines.withColumn("begins", begins).withColumn("index", (F.sum(F.col("begins").cast("int")).over(w) - 1).cast("int"))
    x = x.withColumn("width", F.last(F.when(F.col("begins"), F.length(F.regexp_extract("line", mark, 0))), True).over(w))
    x = x.withColumn("after", F.trim(F.lag("line", 1, "-").over(w)) == "")
    own = F.when(F.col("begins"), F.expr("substr(line, width + 1)")).otherwise(F.expr("substr(line, least(length(regexp_extract(line, '^ *', 0)), width) + 1)"))
    items = x.groupBy(*keys, "index").agg(F.min("n").alias("line"), F.first("ordered").alias("ordered"), F.first("start").alias("start"), F.min_by("after", "n").alias("spaced"), F.transform(F.array_sort(F.collect_list(F.struct("n", own.alias("s")))), lambda s: s["s"]).alias("ls"))
    box = F.regexp_extract(F.get("ls", F.lit(0)), r"^\[([ xX])\] ", 1)
    joined = F.array_join("ls", "\n")
    return items.select(*keys, "line", "index", "ordered", "start", F.when(F.lower(box) == "x", True).alias("checked"), F.when(box != "", F.expr("substr(array_join(ls, '\\n'), 5)")).otherwise(joined).alias("text"), "spaced")


def table_array(text: Column) -> Column:
    """Cells (section, row, col, text, colspan, rowspan, align) of a pipe table; the second line sets alignments and columns."""
    lines = F.split(text, "\n")
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    rule = F.transform(cells(F.get(lines, F.lit(1))), lambda c: F.when(c.rlike("^:-+:$"), "center").when(c.rlike("-:$"), "right").when(c.rlike("^:"), "left"))
    rows = F.transform(F.filter(lines, lambda _, i: i != 1), lambda line: cells(line))
    cell = lambda row, r, align, c: F.struct(F.when(r == 0, "thead").otherwise("tbody").alias("section"), F.greatest(r - 1, F.lit(0)).alias("row"), c.alias("col"), F.coalesce(F.get(row, c), F.lit("")).alias("text"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan"), align.alias("align"))
    return F.flatten(F.transform(rows, lambda row, r: F.transform(rule, lambda align, c: cell(row, r, align, c))))


def defined(definitions: DataFrame) -> DataFrame:
    """(doc_id, targets): a map from the labels of link definitions (doc_id, pos, text) to what follows them; the first of a label counts."""
    form = r"^ {0,3}\[((?:[^\[\]])+)\]:\s*<?([^\s>]+)>?(?:\s+[\"'(](.*)[\"')])?\s*$"
    part = lambda i: F.regexp_extract("text", form, i)
    target = F.concat(part(2), F.when(part(3) != "", F.concat(F.lit(' "'), F.replace(part(3), F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(""))
    firsts = definitions.groupBy("doc_id", label_of(part(1)).alias("label")).agg(F.min_by(target, "pos").alias("target"))
    return firsts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "target"))).alias("targets"))


def label_of(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def linked(text: Column, targets: Column) -> Column:
    """Text in which `[said][label]`, `[label][]` and `[label]` have become `[said](target)` where `targets` (or null) has the label."""
    from leafmill.functions.inlines import let, pieces

    form = r"\[((?:[^\[\]\\]|\\.)+)\](?:\[([^\[\]]*)\]|(?![\[(:]))"

    def one(m: Column) -> Column:
        said, label = F.regexp_extract(m, form, 1), F.regexp_extract(m, form, 2)
        target = F.try_element_at(targets, label_of(F.when(label == "", said).otherwise(label)))
        return F.coalesce(F.concat(F.lit("["), said, F.lit("]("), target, F.lit(")")), m)

    plain, marks = pieces(text, form)
    woven = let(marks, lambda ms: F.array_join(F.transform(plain, lambda p, i: F.concat(p, F.coalesce(one(F.get(ms, i)), F.lit("")))), ""))
    return F.when(targets.isNotNull() & F.contains(text, F.lit("[")), woven).otherwise(text)


def markdown_documents(docs: DataFrame, key: str = "doc_id", smart: bool = True) -> DataFrame:
    """Blocks as renderers take them, with their inlines and cells, of Markdown documents (key, text); doc_id is the key.

    Lists, items, quotes and footnotes are read again, all those of one depth at a time, each pass cut off, until
    nothing is left that holds other blocks. Link definitions count for the whole document and go. Headings without
    an id get one from their text, different from all before it. Notes come last. Empty and null texts have no blocks.
    """
    from leafmill.tables import Tables

    tables = Tables(docs)
    stored = tables.stored
    at = ["doc_id", "parent", "base", "depth"]
    todo = docs.select(F.struct(F.col(key).alias("doc_id"), F.lit(-1).cast("long").alias("parent"), F.lit(0).alias("base"), F.lit(0).alias("depth")).alias("at"), "text")
    place = lambda line, depth: F.col(line).cast("long") * PLACES + F.col(depth)
    found = []
    while True:
        blocks = markdown_blocks(todo, "at", whole_lists=True).select("at.*", "kind", "level", "ident", "language", "text", "spaced", (F.col("at.base") + F.col("pos")).alias("line"))
        late = F.when((F.col("kind") == "footnote") & (F.col("depth") == 0), F.lit(NOTES)).otherwise(0)
        blocks = stored(blocks.withColumn("pos", place("line", "depth") + late))
        items = list_items(blocks.where("kind = 'list'").select("doc_id", F.col("pos").alias("list"), F.col("line").alias("first"), (F.col("depth") + 1).alias("depth"), "text"), ["doc_id", "list", "first", "depth"])
        items = stored(items.withColumn("line", F.col("first") + F.col("line")).withColumn("pos", place("line", "depth")))
        numbered = items.groupBy("doc_id", F.col("list").alias("pos")).agg(F.first("ordered").alias("ordered"), F.first("start").alias("start"))
        found += [
            blocks.join(numbered, ["doc_id", "pos"], "left").select("doc_id", "pos", "parent", "depth", "kind", "level", "ident", "language", "text", "ordered", "start", null("int").alias("index"), null("boolean").alias("checked"), "spaced"),
            items.select("doc_id", "pos", F.col("list").alias("parent"), "depth", F.lit("item").alias("kind"), null("int").alias("level"), null("string").alias("ident"), null("string").alias("language"), null("string").alias("text"), "ordered", "start", "index", "checked", "spaced"),
        ]
        held = blocks.where("kind IN ('blockquote', 'footnote')").select("doc_id", F.col("pos").alias("parent"), F.col("line").alias("base"), (F.col("depth") + 1).alias("depth"), "text")
        held = held.unionByName(items.select("doc_id", F.col("pos").alias("parent"), F.col("line").alias("base"), (F.col("depth") + 1).alias("depth"), "text"))
        if held.isEmpty():
            break
        todo = held.select(F.struct(*at).alias("at"), "text")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    is_table = (F.col("kind") == "table") & F.get(F.split("text", "\n"), F.lit(1)).rlike(r"^[\s|:-]*-[\s|:-]*$")
    out = out.withColumn("kind", F.when((F.col("kind") == "table") & ~F.coalesce(is_table, F.lit(False)), "paragraph").otherwise(F.col("kind")))
    definitions = stored(out.where("kind = 'link_definition'").select("doc_id", "pos", "text"))
    out = out.where("kind != 'link_definition'")
    if not definitions.isEmpty():
        read = F.col("kind").isin("paragraph", "heading", "table")
        out = out.join(defined(definitions), "doc_id", "left").withColumn("text", F.when(read, linked(F.col("text"), F.col("targets"))).otherwise(F.col("text"))).drop("targets")
    leaf = F.col("kind").isin("paragraph", "heading")
    ended = F.when((F.col("kind") == "code") & (F.col("text") != ""), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    cells = F.transform(table_array(F.col("text")), lambda c: F.struct(*[c[n].alias(n) for n in CELL], inline_array(c["text"], smart).alias("inlines")))
    out = stored(out.withColumns({"text": ended, "parent": F.nullif("parent", F.lit(-1)), "inlines": F.when(leaf, with_breaks(inline_array(F.col("text"), smart))), "cells": F.when(F.col("kind") == "table", cells)}))
    return tables.keep(with_tight(with_ids(out)))


def with_tight(blocks: DataFrame) -> DataFrame:
    """Blocks with `tight` for lists: whether no item and no block right inside an item has a blank line before it. Their column spaced goes."""
    items = blocks.where("kind = 'item'").select("doc_id", "pos", F.col("parent").alias("list"), "spaced")
    apart = blocks.where("kind != 'item' AND spaced AND parent IS NOT NULL").select("doc_id", F.col("parent").alias("pos")).distinct().withColumn("apart", F.lit(True))
    loose = items.join(apart, ["doc_id", "pos"], "left").where("spaced OR apart").select("doc_id", F.col("list").alias("pos")).distinct().withColumn("loose", F.lit(True))
    return blocks.join(loose, ["doc_id", "pos"], "left").withColumn("tight", F.when(F.col("kind") == "list", F.col("loose").isNull())).drop("loose", "spaced")


CELL = ["section", "row", "col", "text", "colspan", "rowspan", "align"]


def with_ids(blocks: DataFrame) -> DataFrame:
    """Blocks whose headings without an ident get one from the text of their inlines; repeated ones a number."""
    from leafmill.functions.text import slugify
    from leafmill.operators.outline import dedup_ids

    said = F.array_join(F.transform(F.filter("inlines", lambda x: ~x["kind"].isin("footnote_ref", "image")), lambda x: F.when(x["kind"].isin("soft_break", "hard_break"), " ").otherwise(F.coalesce(x["value"], F.lit("")))), "")
    headings = blocks.where("kind = 'heading' AND ident IS NULL").select("doc_id", "pos", slugify(said).alias("slug")).where("slug != ''")
    made = dedup_ids(headings).select("doc_id", "pos", "id")
    return blocks.join(made, ["doc_id", "pos"], "left").withColumn("ident", F.coalesce("ident", "id")).drop("id")


def promote_math(blocks: DataFrame) -> DataFrame:
    """Paragraphs that hold nothing but $$ ... $$ become math blocks."""
    inner = F.regexp_extract("text", r"(?s)^\s*\$\$(.+)\$\$\s*$", 1)
    is_math = (F.col("kind") == "paragraph") & (inner != "") & ~F.contains(inner, F.lit("$$"))
    return blocks.withColumns({"kind": F.when(is_math, "math").otherwise(F.col("kind")), "text": F.when(is_math, F.trim(inner)).otherwise(F.col("text"))})


def attributed(inlines: DataFrame) -> DataFrame:
    """Inlines (doc_id, pos, ipos, kind, value, url) with attributes that follow them.

    A text that begins with {...} right after an image or code gives it its attributes, or makes code raw
    if it is {=format}; the braces go from the text.
    """
    from pyspark.sql import Window

    from leafmill.functions.text import parse_attrs, raw_format

    w = Window.partitionBy("doc_id", "pos").orderBy("ipos")
    block = lambda c: F.regexp_extract(c, r"^(\{[^{}]*\})", 1)
    following = F.when(F.lead("kind").over(w) == "text", F.nullif(block(F.lead("value").over(w)), F.lit("")))
    x = inlines.withColumns({"_next": following, "_last": F.lag("kind").over(w)})
    takes = F.col("kind").isin("image", "code") & F.col("_next").isNotNull() & (raw_format(F.col("_next")).isNotNull() | parse_attrs(F.col("_next")).isNotNull())
    x = x.withColumn("_takes", takes).withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    raw = F.when(F.col("_takes") & (F.col("kind") == "code"), raw_format(F.col("_next")))
    out = x.withColumns({"format": raw, "attrs": F.when(F.col("_takes") & raw.isNull(), parse_attrs(F.col("_next"))), "value": F.when(F.col("_taken"), F.regexp_replace("value", r"^\{[^{}]*\}", "")).otherwise(F.col("value"))})
    return out.withColumn("kind", F.when(F.col("format").isNotNull(), "raw").otherwise(F.col("kind"))).where("NOT _taken OR value != ''").drop("_next", "_last", "_takes", "_taken")


def bracketed_spans(pieces: DataFrame) -> DataFrame:
    """(keys of pieces, n, text, id, classes) of the spans [text]{attributes} in the column text; brackets may nest once."""
    from leafmill.functions.text import parse_attrs

    keys = [c for c in pieces.columns if c != "text"]
    span = r"\[((?:[^\[\]]++|\[[^\[\]]*+\])*+)\](\{[^{}]*\})"
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(span), 1).alias("text"), F.regexp_extract_all("text", F.lit(span), 2).alias("attrs"))
    each = pieces.select(*keys, F.posexplode(found).alias("n", "s")).withColumn("a", parse_attrs(F.col("s.attrs"))).where("a IS NOT NULL")
    return each.select(*keys, "n", "s.text", "a.id", "a.classes")


def front_matter(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title, date, keywords, authors, rest, body) of documents (key, text) that may begin with a --- block.

    Reads `name: value`, `name: [a, b]` and lists of `- item` lines; keywords may be called tags, authors
    author. What has no field of its own is in rest. Anything else in the block is passed over.
    """
    block = r"(?s)^---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)$"
    has = F.col("text").rlike(block)
    head = F.when(has, F.regexp_extract("text", block, 1)).otherwise("")
    entry = r"(?m)^([\w-]+):[ \t]*(.*(?:\n[ \t]*- .*)*)$"
    clean = lambda c: F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")
    names = F.transform(F.regexp_extract_all(head, F.lit(entry), 1), lambda n: F.lower(n))
    fields = F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda n: F.element_at(F.regexp_extract_all(head, F.lit(entry), 2), F.array_position(names, n).cast("int"))))
    d = docs.select(key, F.coalesce("text", F.lit("")).alias("text")).withColumn("f", fields)
    get = lambda *n: F.coalesce(*[F.try_element_at("f", F.lit(x)) for x in n])

    def several(c):
        flow, lines = F.regexp_extract(c, r"^\[(.*)\]$", 1), F.regexp_extract_all(c, F.lit(r"(?m)^[ \t]*- (.*)$"), 1)
        many = F.when(flow != "", F.split(flow, ",")).when(F.size(lines) > 0, lines).otherwise(F.array(c))
        return F.when(c.isNotNull(), F.transform(many, lambda x: clean(x)))

    known = ["title", "date", "keywords", "tags", "author", "authors"]
    body = F.when(has, F.regexp_extract("text", block, 2)).otherwise(F.col("text"))
    rest = F.transform_values(F.map_filter("f", lambda k, _: ~k.isin(*known)), lambda _, v: clean(v))
    return d.select(key, clean(get("title")).alias("title"), clean(get("date")).alias("date"), several(get("keywords", "tags")).alias("keywords"), several(get("author", "authors")).alias("authors"), rest.alias("rest"), body.alias("body"))


AUTHOR = "struct<name:string,affiliation:string,email:string,orcid:string>"
#: Fields of the front matter that have a column of their own; the last of several names counts.
OWN = {"title": ["title"], "date": ["date"], "abstract": ["abstract", "abstract_text", "description"], "keywords": ["keywords", "tags"], "authors": ["author", "authors"]}


def document_metadata(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title, date, abstract, keywords, authors, custom, body) of documents (key, text) that may begin with nested YAML between --- lines.

    Authors are structs, from a text, a list of texts or a list of maps with a name. Keywords are the texts of a list, or
    a text cut at commas. Any other field stays as it is, however deep, in the VARIANT custom. YAML that cannot be read
    gives no metadata; null texts are empty.
    """
    from leafmill.functions.yaml import yaml_json

    block = r"(?s)\A---[ \t]*\r?\n(?:(.*?)\r?\n)??---[ \t]*(?:\r?\n(.*))?\z"
    text = F.coalesce("text", F.lit(""))
    has = text.rlike(block)
    d = docs.select(key, text.alias("text")).withColumn("json", F.when(has, yaml_json(F.regexp_extract("text", block, 1))))
    d = d.withColumns({"v": F.parse_json("json"), "f": F.from_json("json", "map<string,variant>")})
    first = lambda name, kind: F.coalesce(*[F.try_variant_get("v", f"$.{n}", kind) for n in reversed(OWN[name])])
    raw = lambda name: F.coalesce(*[F.get_json_object("json", f"$.{n}") for n in reversed(OWN[name])])
    is_list = lambda name: F.coalesce(*[F.schema_of_variant(F.try_element_at("f", F.lit(n))) for n in reversed(OWN[name])]).startswith("ARRAY")
    each = lambda name: first(name, "array<variant>")
    is_text = lambda x: F.schema_of_variant(x) == "STRING"
    words = F.when(is_list("keywords"), F.transform(F.filter(each("keywords"), is_text), lambda x: x.cast("string"))).otherwise(F.transform(F.split(raw("keywords"), ","), lambda x: F.trim(x)))
    get = lambda x, n: F.try_variant_get(x, f"$.{n}", "string").alias(n)
    named = lambda x: F.when(is_text(x), F.struct(x.cast("string").alias("name"), *[F.lit(None).cast("string").alias(n) for n in ("affiliation", "email", "orcid")])).otherwise(F.struct(*[get(x, n) for n in ("name", "affiliation", "email", "orcid")]))
    several = F.filter(F.transform(each("authors"), lambda x: named(x).cast(AUTHOR)), lambda a: a["name"].isNotNull())
    single = F.array(F.struct(raw("authors").alias("name"), *[F.lit(None).cast("string").alias(n) for n in ("affiliation", "email", "orcid")]).cast(AUTHOR))
    is_map = lambda name: F.coalesce(raw(name), F.lit("")).startswith("{")
    authors = F.when(is_list("authors"), several).when(raw("authors").isNotNull() & ~is_map("authors"), single)
    known = [n for names in OWN.values() for n in names]
    custom = F.to_variant_object(F.map_filter("f", lambda k, _: ~k.isin(*known)))
    body = F.when(has, F.regexp_extract("text", block, 2)).otherwise(F.col("text"))
    return d.select(key, *[F.when(~F.coalesce(raw(n), F.lit("")).rlike(r"^[\[{]"), raw(n)).alias(n) for n in ("title", "date", "abstract")], words.alias("keywords"), authors.alias("authors"), custom.alias("custom"), body.alias("body"))
