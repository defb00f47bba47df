"""Tables and assembled texts, put together by ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.inlines import let
from leafmill.functions.text import escape_html

ORDER = {"thead": 0, "tbody": 1, "tfoot": 2}


def in_order(*keys: str, piece: Column, sep: str = "") -> Column:
    """Pieces of a group, joined in the order of keys."""
    return F.concat_ws(sep, F.array_sort(F.collect_list(F.struct(*keys, piece.alias("_piece"))))["_piece"])


def assemble_text(pieces: DataFrame, key: str = "doc_id", sep: str = "") -> DataFrame:
    """One text for each document from pieces (key, pos, piece)."""
    return pieces.groupBy(key).agg(in_order("pos", piece=F.col("piece"), sep=sep).alias("text"))


def section_order(c: Column) -> Column:
    return F.when(c == "thead", 0).when(c == "tbody", 1).otherwise(2)


def table_shape(cells: DataFrame) -> DataFrame:
    """n_cols (of the longest row) and n_rows (of the body) of each document's table."""
    body = F.max(F.when(F.col("section") == "tbody", F.col("row") + 1))
    return cells.groupBy("doc_id").agg((F.max("col") + 1).alias("n_cols"), F.coalesce(body, F.lit(0)).alias("n_rows"))


def html_table(cells: DataFrame) -> DataFrame:
    """Cells as HTML: rows from cells, sections from rows, the table from sections.

    A cell holds a paragraph, unless it is empty: of `said`, if there is such a column (rendered already), else of its text.
    """
    said_in = F.col("said") if "said" in cells.columns else escape_html(F.col("text"))
    content = F.when(said_in == "", "").otherwise(F.concat(F.lit("<p>"), said_in, F.lit("</p>\n")))
    tag = F.when(F.col("section") == "thead", "th").otherwise("td")
    said = [F.when(F.col(n) != 1, F.concat(F.lit(f' {n}="'), F.col(n), F.lit('"'))).otherwise("") for n in ("colspan", "rowspan")]
    style = F.when(F.col("align").isNotNull(), F.concat(F.lit(' style="text-align: '), F.col("align"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, *said, style, F.lit(">"), content, F.lit("</"), tag, F.lit(">"))
    rows = cells.groupBy("doc_id", "section", "row").agg(in_order("col", piece=cell).alias("r"))
    sections = rows.groupBy("doc_id", "section").agg(in_order("row", piece=F.concat(F.lit("<tr>"), "r", F.lit("</tr>\n"))).alias("s"))
    sections = sections.select("doc_id", section_order(F.col("section")).alias("order"), F.concat(F.lit("<"), "section", F.lit(">\n"), "s", F.lit("</"), "section", F.lit(">\n")).alias("s"))
    return sections.groupBy("doc_id").agg(F.concat(F.lit("<table>\n"), in_order("order", piece=F.col("s")), F.lit("</table>\n")).alias("html"))


def cells_in_order(cells: DataFrame, *more: str) -> DataFrame:
    """(doc_id, cells): the cells of each table as one array by section, row and col, so that they are read and grouped once."""
    text = F.col("said") if "said" in cells.columns else F.col("text")
    return cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(section_order(F.col("section")).alias("order"), "row", "col", text.alias("text"), *more))).alias("cells"))


def row_ends(i: Column, beside: int) -> Column:
    """Whether the cell at i of the column cells has none of its row beside it, before (-1) or after it (1)."""
    one, other = F.get("cells", i), F.get("cells", i + beside)
    return F.coalesce((other["order"] != one["order"]) | (other["row"] != one["row"]), F.lit(True))


def markdown_table(cells: DataFrame) -> DataFrame:
    """Cells as a pipe table: head (empty ones if there is none), a row of alignments, body, and the foot as a row."""
    whole = cells_in_order(cells, "align").withColumn("sides", F.array_distinct(F.transform("cells", lambda c: F.struct(c["col"].alias("col"), c["align"].alias("align")))))
    text = lambda c: F.coalesce(F.replace(c["text"], F.lit("|"), F.lit("\\|")), F.lit(""))
    piece = lambda c, i: F.struct(c["order"].alias("order"), F.concat(F.when(row_ends(i, -1), "| ").otherwise(" | "), text(c), F.when(row_ends(i, 1), " |\n").otherwise("")).alias("s"))
    mark = lambda a: F.when(a == "right", "---:").when(a == "center", ":---:").when(a == "left", ":---").otherwise("---")
    side = lambda c: mark(F.array_max(F.transform(F.filter("sides", lambda x: x["col"] == c), lambda x: x["align"])))
    columns = F.array_sort(F.array_distinct(F.transform("sides", lambda x: x["col"])))
    empty = F.concat(F.lit("|"), F.repeat(F.lit("  |"), F.size(columns)), F.lit("\n"))
    headed = F.get("cells", F.lit(0))["order"] == 0
    rule = F.concat(F.when(headed, "").otherwise(empty), F.lit("| "), F.array_join(F.transform(columns, side), " | "), F.lit(" |\n"))
    part = lambda ps, test: F.array_join(F.transform(F.filter(ps, test), lambda p: p["s"]), "")
    return whole.select("doc_id", let(F.transform("cells", piece), lambda ps: F.concat(part(ps, lambda p: p["order"] == 0), rule, part(ps, lambda p: p["order"] > 0))).alias("markdown"))


def plaintext_table(cells: DataFrame) -> DataFrame:
    """Cells as a grid of characters; columns are as wide as their longest text in bytes, three at least. A row without a cell of a column has an empty one."""
    text = lambda c: F.coalesce(c["text"], F.lit(""))
    pad = lambda n: F.repeat(F.lit(" "), n)
    columns = F.array_sort(F.array_distinct(F.transform("cells", lambda c: c["col"])))
    longest = lambda col: F.array_max(F.transform(F.filter("cells", lambda c: c["col"] == col), lambda c: F.octet_length(text(c))))
    widths = let(columns, lambda cols: F.transform(cols, lambda col: F.greatest(longest(col), F.lit(3))))
    whole = cells_in_order(cells).withColumns({"columns": columns, "widths": widths})
    whole = whole.withColumn("rule", F.concat(F.lit("+"), F.array_join(F.transform("widths", lambda w: F.concat(F.repeat(F.lit("-"), w + 2), F.lit("+"))), ""), F.lit("\n")))
    place = lambda c: F.array_position("columns", c["col"]).cast("int")
    empty = lambda first, n: F.array_join(F.transform(F.slice("widths", first, F.greatest(n, F.lit(0))), lambda w: F.concat(F.lit(" "), pad(w), F.lit(" |"))), "")

    def piece(c: Column, i: Column) -> Column:
        before = lambda: F.when(row_ends(i, -1), 0).otherwise(place(F.get("cells", i - 1)))
        begin = F.when(row_ends(i, -1), F.concat(F.when(c["order"] == 2, F.col("rule")).otherwise(""), F.lit("|"))).otherwise("")
        end = lambda at: F.when(row_ends(i, 1), F.concat(empty(at + 1, F.size("widths") - at), F.lit("\n"), F.when(c["order"] == 0, F.col("rule")).otherwise(""))).otherwise("")
        cell = lambda at: F.concat(F.lit(" "), text(c), pad(F.get("widths", at - 1) - F.octet_length(text(c))), F.lit(" |"))
        return let(place(c), lambda at: F.concat(begin, let(before(), lambda b: empty(b + 1, at - b - 1)), cell(at), end(at)))

    return whole.select("doc_id", F.concat("rule", F.array_join(F.transform("cells", piece), ""), "rule").alias("text"))


def wrap_and_eol(docs: DataFrame, columns: int = 72, crlf: bool = False, key: str = "doc_id") -> DataFrame:
    """Wraps paragraphs of documents (key, text); fenced, indented and marked-up lines stay as they are.

    Lines are exploded; the parity of fences and runs of plain lines come from windows, each run is filled
    greedily, and the pieces are joined again.
    """
    from leafmill.functions.text import wrap_paragraph

    text = F.regexp_replace("text", r"\r?\n$", "")
    lines = docs.where("text != ''").select(key, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    fence = F.ltrim("line").rlike(r"^(```|~~~)")
    inside = F.coalesce(F.sum(fence.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    marked = F.col("line").rlike(r"^(    |\t)") | F.ltrim("line").rlike(r"^([#>|<]|[-*+] |:::|[0-9]+\.)")
    blank = F.trim("line") == ""
    kind = F.when(fence | inside | (marked & ~blank), "kept").when(blank, "blank").otherwise("plain")
    k = lines.select(key, "n", "line", kind.alias("kind"))
    new = (F.col("kind") != "plain") | (F.lag("kind", 1, "blank").over(w) != "plain")
    run = k.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = run.groupBy(key, "run").agg(F.min("n").alias("pos"), F.first("kind").alias("kind"), in_order("n", piece=F.col("line"), sep=" ").alias("s"))
    piece = F.when(F.col("kind") == "kept", F.col("s")).when(F.col("kind") == "blank", "").otherwise(wrap_paragraph(F.col("s"), columns))
    out = joined.groupBy(key).agg(F.concat(in_order("pos", piece=piece, sep="\n"), F.lit("\n")).alias("text"))
    return out.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n"))) if crlf else out
