"""Scalar building blocks for markup as Column expressions; none of them runs Python on the executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What LaTeX, its verbatim variant and Typst need escaped.
LATEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "#": r"\#", "$": r"\$", "%": r"\%", "&": r"\&", "~": r"\textasciitilde{}", "_": r"\_", "^": r"\textasciicircum{}"}
LATEX_VERBATIM = {k: LATEX[k] for k in "\\{}"}
TYPST_CLASS = r"[\\*_`$#@<>]"
ALIGNMENT = {"left": "left", "center": "center", "right": "right", "default": "left"}
ATTR_TOKEN = r'(?:[^\s"]|"[^"]*(?:"|$))+'


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Plain replacements, one after the other."""
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), pairs, c)


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Each character replaced at once by its entry, if any, so that entries are not escaped again.

    Characters that stand for entries meanwhile are Unicode non-characters, which no text holds.
    """
    marks = {k: chr(0xFDD0 + i) for i, k in enumerate(table)}
    marked = F.translate(c, "".join(table), "".join(marks.values()))
    return replaced(marked, [(marks[k], v) for k, v in table.items()])


def escape_html(c: Column) -> Column:
    return replaced(c, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escape_attr(c: Column) -> Column:
    return F.replace(escape_html(c), F.lit('"'), F.lit("&quot;"))


def escape_xml(c: Column) -> Column:
    return escape_attr(c)


def escape_yaml(c: Column) -> Column:
    return replaced(c, [("\\", "\\\\"), ('"', '\\"')])


def escape_latex(c: Column, verbatim: bool = False) -> Column:
    return mapped(c, LATEX_VERBATIM if verbatim else LATEX)


def unescape_latex(c: Column) -> Column:
    """Undoes escape_latex. Escapes are found from left to right, each turned into a mark first."""
    out = c
    marks = {}
    # a backslash written out comes first, so that what follows it is not taken for part of an escape
    for i, (char, escaped) in enumerate(LATEX.items()):
        if len(escaped) > 2:
            marks[chr(0xFDD0 + i)] = char
            out = F.replace(out, F.lit(escaped), F.lit(chr(0xFDD0 + i)))
    out = F.regexp_replace(out, r"\\([{}#$%&_])", "$1")
    return replaced(out, list(marks.items()))


def escape_typst(c: Column) -> Column:
    return F.regexp_replace(c, f"({TYPST_CLASS})", r"\\$1")


def escape_typst_url(c: Column) -> Column:
    return escape_yaml(c)


def escape_label(c: Column) -> Column:
    """What a LaTeX label may not hold becomes a hyphen."""
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}:.\-]", "-")


def slugify(c: Column) -> Column:
    """Lower case; spaces and underscores become hyphens, runs of them one; other signs go."""
    hyphens = F.regexp_replace(F.lower(c), "[ _]", "-")
    kept = F.regexp_replace(hyphens, r"[^\p{IsAlphabetic}\p{N}\-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def longest_backticks(c: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("`+"), 0), lambda r: F.length(r))), F.lit(0))


def code_fence(c: Column) -> Column:
    """The fence for a code block: three backticks, or one more than its longest run."""
    return F.repeat(F.lit("`"), F.greatest(longest_backticks(c), F.lit(2)) + 1)


def code_span(c: Column) -> Column:
    """Inline code in delimiters longer than its runs, with spaces inside where it has any."""
    n = longest_backticks(c)
    ticks, pad = F.repeat(F.lit("`"), n + 1), F.when(n > 0, " ").otherwise("")
    return F.concat(ticks, pad, c, pad, ticks)


def parse_attrs(c: Column) -> Column:
    """`{#id .class key=value key="two words"}` as a struct (id, classes, kv); null if any token is none of these."""
    s = F.trim(c)
    inner = F.regexp_extract(s, r"(?s)^\{(.*)\}$", 1)
    tokens = F.regexp_extract_all(inner, F.lit(ATTR_TOKEN), 0)
    good = F.forall(tokens, lambda t: t.rlike(r"(?s)^#.|^\..|^[^#.=][^=]*="))
    pairs = F.transform(F.filter(tokens, lambda t: t.rlike(r"(?s)^[^#.=][^=]*=")), lambda t: F.struct(F.regexp_extract(t, r"(?s)^([^=]+)=", 1).alias("k"), F.regexp_replace(F.regexp_extract(t, r"(?s)^[^=]+=(.*)$", 1), '^"+|"+$', "").alias("v")))
    ids = F.filter(tokens, lambda t: F.startswith(t, F.lit("#")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v")))
    out = F.struct(
        F.substring(F.try_element_at(ids, F.lit(-1)), F.lit(2), F.lit(1 << 30)).alias("id"),
        F.transform(F.filter(tokens, lambda t: F.startswith(t, F.lit("."))), lambda t: F.substring(t, F.lit(2), F.length(t))).alias("classes"),
        F.map_from_entries(last).alias("kv"),
    )
    return F.when(s.rlike(r"(?s)^\{.*\}$") & good, out)


def trailing_attrs(c: Column) -> Column:
    """(text, attrs): an attribute block at the end of a text, with curly quotes made straight, cut off if it is one."""
    block = F.translate(F.regexp_extract(c, r"(\{[^{]*\})$", 1), "“”‘’", "\"\"''")
    attrs = F.when(block != "", parse_attrs(block))
    text = F.when(attrs.isNotNull(), F.regexp_replace(c, r"\s*\{[^{]*\}$", "")).otherwise(c)
    return F.struct(text.alias("text"), attrs.alias("attrs"))


def raw_format(info: Column) -> Column:
    """The format in `{=format}`, or null."""
    return F.nullif(F.trim(F.regexp_extract(F.trim(info), r"^\{=(.*)\}$", 1)), F.lit(""))


def code_info(info: Column) -> Column:
    """(language, raw, attrs) of a fence's info string: a word, `{=format}` or an attribute block."""
    attrs = F.when(F.startswith(F.trim(info), F.lit("{")) & raw_format(info).isNull(), parse_attrs(info))
    word = F.nullif(F.regexp_extract(F.trim(info), r"^(\S*)", 1), F.lit(""))
    language = F.when(raw_format(info).isNotNull(), None).when(attrs.isNotNull(), F.try_element_at(attrs["classes"], F.lit(1))).otherwise(word)
    return F.struct(language.alias("language"), raw_format(info).alias("raw"), attrs.alias("attrs"))


def line_ranges(c: Column) -> Column:
    """`2,4-6` as an array of (lo, hi); parts that are no range are left out."""
    number = lambda x: F.when(F.trim(x).rlike(r"^\+?[0-9]+$"), F.trim(x).try_cast("bigint"))
    part = F.transform(F.split(c, ","), lambda p: F.trim(p))
    ranges = F.transform(part, lambda p: F.struct(number(F.regexp_extract(p, "^([^-]*)", 1)).alias("lo"), number(F.regexp_extract(p, "^(?:[^-]*-)?(.*)$", 1)).alias("hi")))
    return F.filter(ranges, lambda r: r["lo"].isNotNull() & r["hi"].isNotNull() & (r["lo"] < (1 << 32)) & (r["hi"] < (1 << 32)))


def css_to_latex(value: Column, key: str) -> Column:
    """A CSS length for \\includegraphics: per cent become shares of the text's width or height."""
    whole = "\\textheight" if key == "height" else "\\textwidth"
    share = F.regexp_extract(value, r"^([0-9.]+)%$", 1).try_cast("double") / 100
    said = F.regexp_replace(share.cast("string"), r"\.0$", "")
    return F.when(value == "100%", whole).when(share.isNotNull(), F.concat(said, F.lit(whole))).otherwise(value)


def includegraphics_options(kv: Column) -> Column:
    """Options of an image with width and height in a map; a side that is missing is capped."""
    width, height = F.try_element_at(kv, F.lit("width")), F.try_element_at(kv, F.lit("height"))
    given = F.array_compact(F.array(F.concat(F.lit("width="), css_to_latex(width, "width")), F.concat(F.lit("height="), css_to_latex(height, "height"))))
    capped = F.concat(given, F.array_compact(F.array(F.when(height.isNull(), "height=\\textheight"), F.when(width.isNull(), "width=\\textwidth"), F.lit("keepaspectratio"))))
    return F.when(F.size(given) == 0, "").otherwise(F.concat(F.lit("["), F.array_join(capped, ","), F.lit("]")))


def strip_number(c: Column) -> Column:
    return F.regexp_replace(c, "^[0-9.]+ ", "")


def shift_heading(level: Column, by: Column) -> Column:
    return F.least(F.lit(6), F.greatest(F.lit(1), level + by))


def image_mime(data: Column) -> Column:
    """PNG or JPEG by the first bytes, else null."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head == "89504E47", "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg")


def png_size(data: Column) -> Column:
    """(width, height) from a PNG header, else nulls."""
    side = lambda at: F.when(image_mime(data) == "image/png", F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long"))
    return F.struct(side(17).alias("width"), side(21).alias("height"))


def list_marker(ordered: Column, start: Column, index: Column, checked: Column) -> Column:
    """`3. ` or `- `, then a box for task items."""
    box = F.when(checked, "[x] ").when(~checked, "[ ] ").otherwise("")
    return F.concat(F.when(ordered, F.concat((F.coalesce(start, F.lit(1)) + index).cast("string"), F.lit(". "))).otherwise("- "), box)


def entry(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def wrap_paragraph(text: Column, columns: int = 72) -> Column:
    """Words of a paragraph in lines of no more than `columns` bytes, filled greedily."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(state: Column, w: Column) -> Column:
        full = F.octet_length(state["line"]) + 1 + F.octet_length(w) > columns
        lines = F.when((state["line"] != "") & full, F.concat(state["lines"], F.array(state["line"]))).otherwise(state["lines"])
        line = F.when((state["line"] == "") | full, w).otherwise(F.concat_ws(" ", state["line"], w))
        return F.struct(lines.alias("lines"), line.alias("line"))

    return F.aggregate(words, start, add, lambda s: F.array_join(F.concat(s["lines"], F.array(s["line"])), "\n"))
