"""Inlines as one array of events, and the pairing of marks that open and close them.

An inline is a struct (kind, value, url, title). A leaf has a value. What holds other inlines is two events, one of its
kind with a null value where it begins and one of kind `/kind` where it ends; both have its url and title. What holds
nothing but one text is a leaf with that text as value. So a tree of inlines is written down in reading order: the
depth of an event is a running sum, and to render a tree is to render its events one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT = "struct<kind:string,value:string,url:string,title:string>"


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def event(kind: Column, value: Column | None = None, url: Column | None = None, title: Column | None = None) -> Column:
    fields = [(kind, "kind"), (value, "value"), (url, "url"), (title, "title")]
    return F.struct(*[(null() if c is None else c.cast("string")).alias(n) for c, n in fields])


def token(kind: Column, value: Column, url: Column | None = None, title: Column | None = None, sign: Column | None = None, opens: Column | None = None, closes: Column | None = None) -> Column:
    """A leaf, or a mark (with a sign) that may open or close; value is what a mark is if nothing answers it."""
    text = [(kind, "kind"), (value, "value"), (url, "url"), (title, "title"), (sign, "sign")]
    flags = [(opens, "opens"), (closes, "closes")]
    return F.struct(*[(null() if c is None else c.cast("string")).alias(n) for c, n in text], *[(F.lit(False) if c is None else F.coalesce(c, F.lit(False))).alias(n) for c, n in flags])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(text: Column, mark: str) -> tuple[Column, Column]:
    """(plain, marks): what stands between the matches of a pattern in a text, and these; plain[i] comes before marks[i].

    This is what split and regexp_extract_all give, but split compiles a pattern anew for each row. A match is never
    empty; back references of `mark` are by name. Empty texts may follow the last match.
    """
    form = rf"((?s:.*?))(?:({mark})|\z)"
    return F.regexp_extract_all(text, F.lit(form), 1), F.filter(F.regexp_extract_all(text, F.lit(form), 2), lambda m: m != "")


def tokens(text: Column, form: str, group: int) -> Column:
    """The matches of a pattern that takes all of a text: group 1 is plain text, `group` a mark. Marks begin with \\x02, plain text ends with it.

    The pattern is tried once at each place; a text that has \\x01 or \\x02 itself cannot be told from this (see `readable`).
    """
    return F.regexp_extract_all(F.regexp_replace(text, form, f"\x01$1\x02${group}"), F.lit("\x01([^\x01]*+)"), 1)


def readable(text: Column, ts: Column, paired: str) -> Column:
    """Whether no token of a text matches `paired`, so each is an event by itself."""
    return ~(F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02")) | F.exists(ts, lambda t: t.rlike(paired)))


#: The sign of marks that nothing pairs across.
WALL = "["
#: Signs whose marks are one character each: two pairs right around each other are one of the other kind.
DOUBLED = ("*", "_")


def paired(tokens: Column) -> Column:
    """Events of an array of tokens: marks that open and close the same are paired by a stack, in one fold over the marks.

    A closing mark takes the nearest open one of its sign, but none beyond a WALL; what has been opened in between
    stays text. A pair has the kind, url and title of its closing mark, else of its opening one. Single pairs of
    DOUBLED signs are emphasis; two right around each other are strong, counted from the inside.
    """
    numbered = F.transform(tokens, lambda t, i: F.struct(i.alias("i"), *[t[n].alias(n) for n in ("kind", "value", "url", "title", "sign", "opens", "closes")]))
    pair = "array<struct<o:int,c:int,sign:string,kind:string,url:string,title:string,n:int>>"
    open_ = "array<struct<i:int,sign:string,kind:string,url:string,title:string>>"
    begin = F.struct(F.array().cast(open_).alias("stack"), F.array().cast(pair).alias("pairs"))

    def step(a: Column, t: Column) -> Column:
        signs = F.reverse(F.transform(a["stack"], lambda x: x["sign"]))
        own, wall = F.array_position(signs, t["sign"]), F.array_position(signs, F.lit(WALL))

        def with_place(place: Column) -> Column:
            o = F.get(a["stack"], (F.size(a["stack"]) - place).cast("int"))
            last = F.get(a["pairs"], F.size(a["pairs"]) - 1)
            around = (last["o"] == o["i"] + 1) & (last["c"] == t["i"] - 1) & (last["sign"] == t["sign"]) & t["sign"].isin(*DOUBLED)
            new = F.struct(
                o["i"].alias("o"), t["i"].alias("c"), t["sign"].alias("sign"), F.coalesce(t["kind"], o["kind"]).alias("kind"), F.coalesce(t["url"], o["url"]).alias("url"),
                F.coalesce(t["title"], o["title"]).alias("title"), F.when(F.coalesce(around, F.lit(False)), last["n"] + 1).otherwise(1).alias("n"),
            )
            closed = F.struct(F.slice(a["stack"], F.lit(1), (F.size(a["stack"]) - place).cast("int")).cast(open_).alias("stack"), F.concat(a["pairs"], F.array(new).cast(pair)).cast(pair).alias("pairs"))
            opened = F.struct(F.concat(a["stack"], F.array(F.struct(*[t[n].alias(n) for n in ("i", "sign", "kind", "url", "title")])).cast(open_)).cast(open_).alias("stack"), a["pairs"].cast(pair).alias("pairs"))
            return F.when(place > 0, closed).when(t["opens"], opened).otherwise(F.struct(a["stack"].cast(open_).alias("stack"), a["pairs"].cast(pair).alias("pairs")))

        return let(F.when(t["closes"] & (own > 0) & ((wall == 0) | (own <= wall)), own).otherwise(0).cast("int"), with_place)

    def woven(ts: Column) -> Column:
        pairs = F.aggregate(F.filter(ts, lambda t: t["sign"].isNotNull()), begin, step, lambda a: a["pairs"])
        return let(pairs, lambda ps: put(ts, ps))

    def put(ts: Column, ps: Column) -> Column:
        used = F.flatten(F.transform(ps, lambda p: F.array(p["o"], p["c"])))
        kept = F.filter(ps, lambda p, j: F.coalesce(F.get(ps, j + 1)["n"] % 2 == 1, F.lit(True)))
        kind = lambda p: F.when(p["sign"].isin(*DOUBLED), F.when(p["n"] % 2 == 0, "strong").otherwise("emphasis")).otherwise(p["kind"])
        place = lambda i, e: F.struct(i.alias("i"), e.alias("e"))

        def rest(u: Column) -> Column:
            plain = F.filter(ts, lambda t: t["sign"].isNull() | ~F.array_contains(u, t["i"]))
            said = F.transform(plain, lambda t: place(t["i"], event(F.when(t["sign"].isNull(), t["kind"]).otherwise("text"), t["value"], F.when(t["sign"].isNull(), t["url"]), F.when(t["sign"].isNull(), t["title"]))))
            first = F.transform(kept, lambda p: place(p["o"], event(kind(p), None, p["url"], p["title"])))
            last = F.transform(kept, lambda p: place(p["c"], event(F.concat(F.lit("/"), kind(p)), None, p["url"], p["title"])))
            return F.transform(F.array_sort(F.concat(said, first, last)), lambda x: x["e"])

        return let(used, rest)

    leaves = lambda ts: F.transform(ts, lambda t: event(t["kind"], t["value"], t["url"], t["title"]))
    events = let(numbered, lambda ts: F.when(F.exists(ts, lambda t: t["sign"].isNotNull()), woven(ts)).otherwise(leaves(ts)))
    return folded(joined(events))


def joined(events: Column) -> Column:
    """Events with texts that stand side by side as one; empty ones go."""
    is_text = lambda e: e["kind"] == "text"
    full = F.filter(events, lambda e: ~is_text(e) | (e["value"] != ""))

    def one(es: Column) -> Column:
        follows = lambda i: F.coalesce(is_text(F.get(es, i)) & is_text(F.get(es, i - 1)), F.lit(False))
        begins = F.filter(F.transform(es, lambda _, i: F.when(~follows(i), i)), lambda i: i.isNotNull())

        def runs(b: Column) -> Column:
            return F.transform(b, lambda i, n: let(F.slice(es, i + 1, F.coalesce(F.get(b, n + 1), F.size(es)) - i), lambda r: F.when(F.size(r) == 1, F.get(r, F.lit(0))).otherwise(event(F.lit("text"), F.array_join(F.transform(r, lambda x: x["value"]), "")))))

        return F.when(F.size(begins) == F.size(es), es).otherwise(let(begins, runs))

    return let(full, one)


def folded(events: Column) -> Column:
    """Events with what holds nothing but a text as a leaf."""

    def one(es: Column) -> Column:
        at = lambda i, n: F.get(es, i)[n]
        holds = lambda i: F.coalesce(at(i, "value").isNull() & (at(i + 1, "kind") == "text") & (at(i + 2, "kind") == F.concat(F.lit("/"), at(i, "kind"))), F.lit(False))
        marked = F.transform(es, lambda e, i: F.when(holds(i), event(e["kind"], at(i + 1, "value"), e["url"], e["title"])).when(~(holds(i - 1) | holds(i - 2)), e))
        return F.filter(marked, lambda e: e.isNotNull())

    return let(events, lambda es: F.when(F.exists(es, lambda e: e["value"].isNull()), one(es)).otherwise(es))


#: Quotation marks, dashes and dots that stand for what is typed.
SMART = [("---", "—"), ("--", "–"), ("...", "…")]


def smart(value: Column, first: Column) -> Column:
    """Text with typographic quotes, dashes and dots; `first` tells whether nothing stands before it."""
    for typed, said in SMART:
        value = F.replace(value, F.lit(typed), F.lit(said))
    some = F.contains(value, F.lit('"')) | F.contains(value, F.lit("'"))
    quoted = F.when(first, value).otherwise(F.regexp_replace(value, r'^"(?!\p{L})', "”"))
    quoted = F.regexp_replace(quoted, r'(?<=[^\s(\[{])"(?!\p{L})', "”")
    quoted = F.replace(quoted, F.lit('"'), F.lit("“"))
    quoted = F.regexp_replace(quoted, "(?<![^\\s(\\[{“])'(?=\\S(?:[^'\\n]*[^\\s'])?'(?![\\p{L}\\p{N}]))", "‘")
    return F.when(some, F.replace(quoted, F.lit("'"), F.lit("’"))).otherwise(value)
