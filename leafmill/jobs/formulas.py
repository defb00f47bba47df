"""Formulas made of parts by templates, of which many repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.operators import math as m

QUERIES: dict = {}
ORACLES: dict = {}

#: Templates in LaTeX, Typst and MathML; # stands for a number.
TEMPLATES = [
    (r"x_# + \alpha^{2}", "x_# + alpha^2", "<msub><mi>x</mi><mn>#</mn></msub><mo>+</mo><msup><mi>α</mi><mn>2</mn></msup>"),
    (r"\frac{a}{#} \leq b", "frac(a, #) lt.eq b", "<mfrac><mi>a</mi><mn>#</mn></mfrac><mo>≤</mo><mi>b</mi>"),
    (r"\sqrt{y} = #", "sqrt(y) = #", "<msqrt><mi>y</mi></msqrt><mo>=</mo><mn>#</mn>"),
    (r"\sum_{i = 1}^# \beta_i", "sum_(i = 1)^# beta_i", "<msubsup><mo>∑</mo><mrow><mi>i</mi><mo>=</mo><mn>1</mn></mrow><mn>#</mn></msubsup><msub><mi>β</mi><mi>i</mi></msub>"),
    (r"n \in \mathbb{N} \to \infty", "n in NN arrow.r infinity", '<mi>n</mi><mo>∈</mo><mi mathvariant="double-struck">N</mi><mo>→</mo><mo>∞</mo>'),
]


def formulas(spark, d, which: int):
    k = F.col("l_partkey") % 23
    form = F.element_at(F.array(*[F.lit(t[which]) for t in TEMPLATES]), (F.col("l_partkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.replace(form, F.lit("#"), k.cast("string")).alias("formula"))


def sql(which: int, around: str = "{}") -> str:
    cases = " ".join(f"WHEN {i} THEN '{t[which]}'" for i, t in enumerate(TEMPLATES))
    said = around.format(f"replace(CASE l_partkey % 5 {cases} END, '#', CAST(l_partkey % 23 AS VARCHAR))")
    return f"SELECT l_orderkey, l_linenumber, l_partkey, {said} AS converted FROM lineitem"


def add(name: str, source: str, target: str | None, which: int, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: m.convert_math(formulas(spark, d, which), source, target).drop("formula")
    ORACLES[name] = oracle


add("c28_math_to_typst", "latex", "typst", 0, sql(1))
add("c29_math_to_mathml", "latex", "mathml", 0, sql(2, "'<math display=\"inline\">' || {} || '</math>'"))
add("c30_typst_math_to_latex", "typst", "latex", 1, sql(0).replace("^{2}", "^2"))
add("c31_math_same_notation", "latex", None, 0, sql(0))

QUERIES["d10_math_symbols"] = lambda spark, d: m.symbol_report(formulas(spark, d, 0))
ORACLES["d10_math_symbols"] = """WITH x AS (SELECT unnest(CASE l_partkey % 5 WHEN 0 THEN ['alpha'] WHEN 1 THEN ['frac', 'leq'] WHEN 2 THEN ['sqrt'] WHEN 3 THEN ['sum', 'beta'] ELSE ['in', 'mathbb', 'to', 'infty'] END) AS command FROM lineitem)
SELECT command, CASE command WHEN 'leq' THEN 'lt.eq' WHEN 'to' THEN 'arrow.r' WHEN 'infty' THEN 'infinity' WHEN 'frac' THEN NULL WHEN 'sqrt' THEN NULL WHEN 'mathbb' THEN NULL ELSE command END AS name, count(*) AS n FROM x GROUP BY command"""
