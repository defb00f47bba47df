"""Formulas in other notations.

A corpus repeats its formulas, so the different ones are converted, in batches inside tasks, and joined
back by their text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Command, Typst name, character. Greek letters have one name in both.
SYMBOLS = [
    *((g, g, c) for g, c in zip("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split(), "αβγδϵζηθικλμνξπρστϕχψω", strict=True)),
    *((g, g, c) for g, c in zip("Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega".split(), "ΓΔΘΛΞΠΣΦΨΩ", strict=True)),
    ("infty", "infinity", "∞"), ("partial", "diff", "∂"), ("nabla", "nabla", "∇"), ("times", "times", "×"), ("cdot", "dot.op", "⋅"), ("pm", "plus.minus", "±"), ("leq", "lt.eq", "≤"), ("geq", "gt.eq", "≥"), ("neq", "eq.not", "≠"), ("approx", "approx", "≈"),
    ("in", "in", "∈"), ("subset", "subset", "⊂"), ("cup", "union", "∪"), ("cap", "sect", "∩"), ("to", "arrow.r", "→"), ("rightarrow", "arrow.r", "→"), ("Rightarrow", "arrow.r.double", "⇒"), ("forall", "forall", "∀"), ("exists", "exists", "∃"), ("ldots", "dots", "…"),
    ("sum", "sum", "∑"), ("prod", "product", "∏"), ("int", "integral", "∫"),
]
FUNCTIONS = ["sin", "cos", "tan", "log", "ln", "exp", "lim", "max", "min", "det"]
TO_TYPST = {c: t for c, t, _ in SYMBOLS}
TO_CHAR = {c: u for c, _, u in SYMBOLS}
FROM_TYPST = {t: c for c, t, _ in reversed(SYMBOLS)}
TOKEN = re.compile(r"\\([A-Za-z]+|.)|([0-9]+(?:\.[0-9]+)?)|(\s+)|(.)", re.S)


def parse(source: str) -> list:
    """A formula as a list of nodes: ("sym", s), ("num", s), ("cmd", name), ("group", nodes), ("frac", a, b), ("sqrt", n, x), ("font", name, x), ("text", s), ("sub" or "sup", x)."""
    tokens = [("cmd", m[1]) if m[1] else ("num", m[2]) if m[2] else ("sym", m[4]) for m in TOKEN.finditer(source) if m[3] is None]
    at = 0

    def item():
        nonlocal at
        if at >= len(tokens):
            return ("group", [])
        kind, s = tokens[at]
        at += 1
        if (kind, s) == ("sym", "{"):
            return ("group", many("}"))
        if kind == "sym" and s in "^_":
            return ("sup" if s == "^" else "sub", item())
        if kind != "cmd":
            return (kind, s)
        if s in ("frac", "tfrac", "dfrac"):
            return ("frac", item(), item())
        if s == "sqrt":
            root = None
            if at < len(tokens) and tokens[at] == ("sym", "["):
                at += 1
                root = ("group", many("]"))
            return ("sqrt", root, item())
        if s in ("mathbb", "mathbf", "mathcal", "mathrm"):
            return ("font", s, item())
        if s in ("text", "operatorname"):
            return ("text", flat(item()))
        if s in ("left", "right"):
            return item()
        return ("cmd", s)

    def many(end: str | None):
        nonlocal at
        out = []
        while at < len(tokens):
            if end and tokens[at] == ("sym", end):
                at += 1
                break
            out.append(item())
        return out

    return many(None)


def flat(node) -> str:
    return node[1] if isinstance(node[1], str) else "".join(flat(n) for n in node[1] if n)


def typst_node(n) -> str:
    kind = n[0]
    if kind == "group":
        return "(" + typst_nodes(n[1]) + ")" if len(n[1]) != 1 else typst_node(n[1][0])
    if kind == "frac":
        return f"frac({inner(n[1])}, {inner(n[2])})"
    if kind == "sqrt":
        return f"root({inner(n[1])}, {inner(n[2])})" if n[1] else f"sqrt({inner(n[2])})"
    if kind == "font":
        name = {"mathbb": "bb", "mathbf": "bold", "mathcal": "cal", "mathrm": "upright"}[n[1]]
        said = flat(n[2])
        return said * 2 if n[1] == "mathbb" and len(said) == 1 else f"{name}({inner(n[2])})"
    if kind == "text":
        return f'"{n[1]}"'
    if kind in ("sup", "sub"):
        return ("^" if kind == "sup" else "_") + typst_node(n[1])
    return TO_TYPST.get(n[1], n[1]) if kind == "cmd" else n[1]


def inner(n) -> str:
    return typst_nodes(n[1]) if n[0] == "group" else typst_node(n)


def typst_nodes(nodes: list) -> str:
    out = ""
    for n in nodes:
        said = typst_node(n)
        out += said if not out or n[0] in ("sup", "sub") else " " + said
    return out


def latex_to_typst(source: str) -> str:
    """LaTeX math in Typst's notation; commands that are not known go by their name."""
    return typst_nodes(parse(source))


def mathml_node(n) -> str:
    kind = n[0]
    if kind == "group":
        return "<mrow>" + mathml_nodes(n[1]) + "</mrow>" if len(n[1]) != 1 else mathml_nodes(n[1])
    if kind == "frac":
        return f"<mfrac>{mathml_node(n[1])}{mathml_node(n[2])}</mfrac>"
    if kind == "sqrt":
        return f"<mroot>{mathml_node(n[2])}{mathml_node(n[1])}</mroot>" if n[1] else f"<msqrt>{mathml_node(n[2])}</msqrt>"
    if kind == "font":
        variant = {"mathbb": "double-struck", "mathbf": "bold", "mathcal": "script", "mathrm": "normal"}[n[1]]
        return f'<mi mathvariant="{variant}">{flat(n[2])}</mi>'
    if kind == "text":
        return f"<mtext>{n[1]}</mtext>"
    if kind == "num":
        return f"<mn>{n[1]}</mn>"
    said = TO_CHAR.get(n[1], n[1]) if kind == "cmd" else n[1]
    letter = said.isalpha() and not (kind == "cmd" and n[1] in ("in",)) and said not in "∑∏∫"
    said = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}.get(said, said)
    return f"<mi>{said}</mi>" if letter else f"<mo>{said}</mo>"


def mathml_nodes(nodes: list) -> str:
    """Nodes in order; scripts take the node before them, both kinds together."""
    out: list[tuple[str, dict]] = []
    for n in nodes:
        if n[0] in ("sup", "sub"):
            if not out:
                out.append(("<mrow></mrow>", {}))
            out[-1][1][n[0]] = mathml_node(n[1])
        else:
            out.append((mathml_node(n), {}))
    said = []
    for base, s in out:
        if len(s) == 2:
            said.append(f"<msubsup>{base}{s['sub']}{s['sup']}</msubsup>")
        elif s:
            kind = next(iter(s))
            said.append(f"<m{kind}>{base}{s[kind]}</m{kind}>")
        else:
            said.append(base)
    return "".join(said)


def latex_to_mathml(source: str, display: bool = False) -> str:
    return f'<math display="{"block" if display else "inline"}">{mathml_nodes(parse(source))}</math>'


TYPST = re.compile(r'"([^"]*)"|([A-Za-z][A-Za-z.]*[A-Za-z]|[A-Za-z])|([0-9]+(?:\.[0-9]+)?)|(\s+)|(.)', re.S)


def typst_to_latex(source: str) -> str:
    """Typst math in LaTeX's notation, for names of SYMBOLS, frac, sqrt, root, fonts, text and scripts."""
    tokens = [("text", m[1]) if m[1] is not None else ("name", m[2]) if m[2] else ("num", m[3]) if m[3] else ("sym", m[5]) for m in TYPST.finditer(source) if m[4] is None]
    at = 0

    def arguments() -> list[str]:
        nonlocal at
        at += 1
        out, part, depth = [], [], 0
        while at < len(tokens):
            if tokens[at] == ("sym", ")") and depth == 0:
                at += 1
                break
            if tokens[at] == ("sym", ",") and depth == 0:
                at += 1
                out.append(" ".join(part))
                part = []
                continue
            part.append(item())
        return [*out, " ".join(part)]

    def item() -> str:
        nonlocal at
        kind, s = tokens[at]
        at += 1
        called = at < len(tokens) and tokens[at] == ("sym", "(")
        if kind == "text":
            return f"\\text{{{s}}}"
        if kind == "name":
            if called and s in ("frac", "sqrt", "root", "bb", "bold", "cal", "upright"):
                a = arguments()
                if s == "frac":
                    return f"\\frac{{{a[0]}}}{{{a[1]}}}"
                if s == "root":
                    return f"\\sqrt[{a[0]}]{{{a[1]}}}"
                command = {"sqrt": "sqrt", "bb": "mathbb", "bold": "mathbf", "cal": "mathcal", "upright": "mathrm"}[s]
                return f"\\{command}{{{a[0]}}}"
            if len(s) == 2 and s[0] == s[1] and s.isupper():
                return f"\\mathbb{{{s[0]}}}"
            return f"\\{FROM_TYPST[s]}" if s in FROM_TYPST else f"\\{s}" if s in FUNCTIONS else s
        if kind == "sym" and s in "^_" and at < len(tokens):
            group = tokens[at] == ("sym", "(")
            x = ", ".join(arguments()) if group else item()
            return f"{s}{{{x}}}" if group else f"{s}{x}"
        return s

    out = ""
    while at < len(tokens):
        x = item()
        out += x if not out or x[0] in "^_" else " " + x
    return out


CONVERTERS: dict[tuple[str, str], Callable[[str], str]] = {
    ("latex", "typst"): latex_to_typst, ("latex", "mathml"): latex_to_mathml, ("typst", "latex"): typst_to_latex, ("typst", "mathml"): lambda s: latex_to_mathml(typst_to_latex(s)),
}


def convert_math(formulas: DataFrame, source: str, target: str | None, column: str = "formula", to: str = "converted") -> DataFrame:
    """Adds `to`: the formula in the target's notation; as it is if that is its own or none.

    Different formulas are converted once each. Nulls stay null.
    """
    if target is None or source == target:
        return formulas.withColumn(to, F.col(column))
    convert = CONVERTERS[(source, target)]

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else convert(s) for s in x], dtype=object)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}  # evaluated, as Spark reads them
    run = F.pandas_udf(run, T.StringType())
    each = formulas.select(F.col(column).alias("_f")).distinct().withColumn(to, run("_f"))
    return formulas.join(each, F.col(column) == F.col("_f"), "left").drop("_f")


def symbol_report(formulas: DataFrame, column: str = "formula") -> DataFrame:
    """(command, name, n): how often each command occurs, with its Typst name; name is null where there is none."""
    spark = formulas.sparkSession
    known = spark.createDataFrame([(c, t) for c, t, _ in SYMBOLS], "command string, name string").dropDuplicates(["command"])
    used = formulas.select(F.explode(F.regexp_extract_all(column, F.lit(r"\\([A-Za-z]+)"), 1)).alias("command")).groupBy("command").agg(F.count("*").alias("n"))
    return used.join(F.broadcast(known), "command", "left").select("command", "name", "n")
