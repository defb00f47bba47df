"""Nested YAML as JSON, in expressions: one fold over the lines finds the path of each value, a second pass writes the tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.inlines import let

#: A step of a path: the name of a field, or an item of a list with its place as name.
STEP = "struct<name:string,item:boolean>"
OPEN = "array<struct<at:int,name:string,item:boolean>>"
TOKENS = "array<struct<at:int,kind:string,name:string,value:string>>"
ENTRY = f"struct<path:array<{STEP}>,value:string,style:string>"
#: `name:` at the beginning of what a line says; names may be in quotes.
PAIR = r"^(\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\[\]{},#&*!|>'\"%@`-][^:#]*?|-[^\s:][^:#]*?)\s*:(?:\s+(.*))?$"
FLOW = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[\[\]{},]|:(?=[\s\[\{\"']|$)|(?:[^\[\]{},:\"'\s]|:(?=\S))(?:[^\[\]{},:]|:(?=[^\s,\]}]))*"


def json_string(c: Column) -> Column:
    """A string as JSON writes it."""
    return let(F.to_json(F.array(c)), lambda quoted: F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def unquoted(c: Column) -> Column:
    """A scalar without its quotes; what a backslash stands for in double quotes comes from JSON."""
    double = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>"), F.lit(0)), F.expr("''"))
    return F.when(c.rlike(r'(?s)^".*"$'), double).when(c.rlike(r"(?s)^'.*'$"), F.replace(F.regexp_replace(c, r"(?s)^'(.*)'$", "$1"), F.lit("''"), F.lit("'"))).otherwise(c)


def scalar(c: Column) -> Column:
    """A scalar as JSON: null, a truth value and a number as such, anything else as a string."""
    plain = F.when(c.isNull() | c.rlike("^(?:~|null|Null|NULL|)$"), "null").when(c.rlike("^(?:true|True|TRUE|false|False|FALSE)$"), F.lower(c))
    return F.coalesce(plain, F.when(c.rlike(r"^-?(?:0|[1-9]\d{0,17})(?:\.\d{1,15})?$"), c), json_string(unquoted(c)))


def flow(c: Column) -> Column:
    """A list or map in brackets as JSON; null if it does not come out as such."""
    found = F.transform(F.regexp_extract_all(c, F.lit(FLOW), 0), lambda t: F.trim(t))
    said = lambda tokens: F.transform(tokens, lambda t, i: F.when(t.isin("[", "]", "{", "}", ",", ":"), t).when(F.get(tokens, i + 1) == ":", json_string(unquoted(t))).otherwise(scalar(t)))
    return let(F.array_join(let(found, said), ""), lambda made: F.when(F.try_parse_json(made).isNotNull(), made))


def _tokens(line: Column) -> Column:
    """What a line says: a token for each dash it begins with, then a pair or a scalar, each with its column."""
    null = F.lit(None)
    token = lambda at, kind, name, value: F.struct(at.cast("int").alias("at"), F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("string").alias("value"))

    def after(lead: Column) -> Column:
        places = F.filter(F.transform(F.split(lead, ""), lambda c, i: F.when(c == "-", i)), lambda i: i.isNotNull())
        dashes = F.when(F.contains(lead, F.lit("-")), F.transform(places, lambda a: token(a, "item", null, null))).otherwise(F.array().cast(TOKENS))
        rest = F.rtrim(F.substring(line, F.length(lead) + 1, F.length(line)))
        return F.concat(dashes, let(let(rest, uncommented), lambda said: own(lead, said)))

    def uncommented(rest: Column) -> Column:
        bare = F.when(F.contains(rest, F.lit("#")), F.regexp_replace(rest, r"(?:^|\s+)#.*$", "")).otherwise(rest)
        return F.when(rest.rlike(r"^[\"']|^[\w -]+:\s+[\"']"), rest).otherwise(F.trim(bare))

    def own(lead: Column, rest: Column) -> Column:
        pair = token(F.length(lead), "pair", let(F.regexp_extract(rest, PAIR, 1), unquoted), F.trim(F.regexp_extract(rest, PAIR, 2)))
        return F.when(rest == "", F.array().cast(TOKENS)).when(rest.rlike(PAIR), F.array(pair)).otherwise(F.array(token(F.length(lead), "scalar", null, rest)))

    return let(F.regexp_extract(line, r"^( *(?:- +|-$)*)", 1), after)


def yaml_entries(text: Column) -> Column:
    """Values of a YAML text with their paths, in order: array of (path, value, style).

    Reads maps and lists by indentation, texts that go on in further lines, and blocks of lines after | and >. The
    style is `|` or `>` for these. A field with nothing has an entry of its own, unless others stand below it.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n")
    begin = F.struct(F.array().cast(OPEN).alias("open"), F.array().cast(f"array<{ENTRY}>").alias("out"), F.lit(-1).alias("block"))

    def state(open_: Column, out: Column, block: Column) -> Column:
        return F.struct(open_.alias("open"), out.alias("out"), block.cast("int").alias("block"))

    def more(a: Column, said: Column, sep: str) -> Column:
        """The last value with another line."""
        n = F.size(a["out"])
        last = F.get(a["out"], n - 1)
        value = F.when(F.coalesce(last["value"], F.lit("")) == "", said).otherwise(F.concat(last["value"], F.lit(sep), said))
        new = F.struct(last["path"].alias("path"), value.alias("value"), last["style"].alias("style"))
        return F.when(n > 0, F.concat(F.slice(a["out"], F.lit(1), n - 1), F.array(new))).otherwise(a["out"])

    def put(a: Column, t: Column) -> Column:
        kept = F.filter(a["open"], lambda o: (o["at"] < t["at"]) | ((t["kind"] == "item") & (o["at"] == t["at"])))

        def on(kept: Column) -> Column:
            top = F.element_at(kept, -1)
            again = F.coalesce((F.size(kept) > 0) & (t["kind"] == "item") & F.try_element_at(kept, F.lit(-1))["item"] & (F.try_element_at(kept, F.lit(-1))["at"] == t["at"]), F.lit(False))
            name = F.when(t["kind"] == "pair", t["name"]).when(again, (top["name"].cast("int") + 1).cast("string")).otherwise("0")
            under = F.when(again, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)
            new = F.concat(under, F.array(F.struct(t["at"].alias("at"), name.alias("name"), (t["kind"] == "item").alias("item"))))
            style = F.regexp_extract(F.coalesce(t["value"], F.lit("")), r"^([|>])[+-]?$", 1)
            value = F.when(style == "", F.nullif(t["value"], F.lit("")))
            entry = let(new, lambda n: F.array(F.struct(F.transform(n, lambda o: F.struct(o["name"].alias("name"), o["item"].alias("item"))).alias("path"), value.alias("value"), F.nullif(style, F.lit("")).alias("style"))))
            return state(new, F.concat(a["out"], entry), F.when(style != "", t["at"]).otherwise(-1))

        return F.when(t["kind"] == "scalar", state(a["open"], more(a, t["value"], " "), a["block"])).otherwise(let(kept, on))

    def step(a: Column, line: Column) -> Column:
        inside = (a["block"] >= 0) & ((F.trim(line) == "") | (F.length(F.regexp_extract(line, "^ *", 0)) > a["block"]))
        comment = line.rlike(r"^\s*(?:#.*)?$")
        raw = F.concat(line, F.lit("\n"))
        free = state(a["open"], a["out"], F.lit(-1))
        return F.when(inside, state(a["open"], more(a, raw, ""), a["block"])).when(comment, free).otherwise(F.aggregate(_tokens(line), free, put))

    found = F.aggregate(lines, begin, step, lambda a: a["out"])

    def below(e: Column, after: Column) -> Column:
        n = F.size(e["path"])
        return e["value"].isNull() & after.isNotNull() & (F.size(after["path"]) > n) & F.coalesce(F.slice(after["path"], F.lit(1), n) == e["path"], F.lit(False))

    return let(found, lambda es: F.filter(es, lambda e, i: ~F.coalesce(below(e, F.get(es, i + 1)), F.lit(False))))


def block_text(value: Column, style: Column) -> Column:
    """Lines of a block without their indentation; > joins those that no blank line parts."""
    indent = F.length(F.regexp_extract(value, r"^\n*( *)", 1))
    cut = F.transform(F.split(F.regexp_replace(value, r"\s+$", ""), "\n"), lambda line: F.substring(line, indent + 1, F.length(line)))
    joined = F.array_join(cut, "\n")
    return F.concat(F.when(style == ">", F.regexp_replace(F.regexp_replace(joined, r"(?<!\n)\n(?!\n)", " "), "\n\n", "\n")).otherwise(joined), F.lit("\n"))


def yaml_json(text: Column) -> Column:
    """A YAML map or list as JSON text; null if it has no value that can be read. Anchors, tags and several documents are not read."""
    opened = lambda s: F.concat(F.when(s["item"], "[").otherwise("{"), name(s))
    name = lambda s: F.when(s["item"], "").otherwise(F.concat(json_string(s["name"]), F.lit(":")))
    closed = lambda steps: F.array_join(F.transform(F.reverse(steps), lambda s: F.when(s["item"], "]").otherwise("}")), "")
    said = lambda e: F.when(e["style"].isNotNull(), json_string(block_text(F.coalesce(e["value"], F.lit("")), e["style"]))).when(e["value"].rlike(r"^[\[{]"), F.coalesce(flow(e["value"]), scalar(e["value"]))).otherwise(scalar(e["value"]))

    def written(es: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(es, i - 1)["path"])

            def after(alike: Column) -> Column:
                rest = F.slice(e["path"], alike + 1, F.size(e["path"]))
                back = F.when(i > 0, F.concat(closed(F.slice(before, alike + 2, F.size(before))), F.lit(","))).otherwise("")
                first = F.when(i > 0, name(F.get(rest, F.lit(0)))).otherwise(opened(F.get(rest, F.lit(0))))
                return F.concat(back, first, F.array_join(F.transform(F.slice(rest, F.lit(2), F.size(rest)), opened), ""), said(e))

            shared = F.size(F.filter(e["path"], lambda s, k: (k < F.size(before)) & (F.slice(e["path"], F.lit(1), k + 1) == F.slice(before, F.lit(1), k + 1))))
            return let(F.when(i > 0, shared).otherwise(0), after)

        return F.concat(F.array_join(F.transform(es, one), ""), closed(F.element_at(es, -1)["path"]))

    made = let(yaml_entries(text), lambda es: F.when(F.size(es) > 0, written(es)))
    return let(made, lambda m: F.when(F.try_parse_json(m).isNotNull(), m))
