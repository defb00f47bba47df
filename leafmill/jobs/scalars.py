"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as t

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc_id and whole text, with signs at its end that prose lacks."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(' {a}_b^c~d\\e `x` ``y`` "q" <i> @k')).alias("s"))


DOCS = "(SELECT doc_id, coalesce(text, '') || ' {a}_b^c~d\\e `x` ``y`` \"q\" <i> @k' AS s FROM documents)"


def part(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet")


@query("c02_slugify", f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(s), '[ _]', '-', 'g'), '[^\\p{{L}}\\p{{N}}-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM {DOCS}")
def slugs(spark, d):
    return documents(spark, d).select("doc_id", t.slugify(F.col("s")).alias("slug"))


@query("c03_escape_html", f"""SELECT doc_id, replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html,
  replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attr FROM {DOCS}""")
def html(spark, d):
    return documents(spark, d).select("doc_id", t.escape_html(F.col("s")).alias("html"), t.escape_attr(F.col("s")).alias("attr"))


LATEX_SQL = "array_to_string(list_transform(string_split({s}, ''), lambda c: CASE c WHEN '\\' THEN '\\textbackslash{{}}' WHEN '~' THEN '\\textasciitilde{{}}' WHEN '^' THEN '\\textasciicircum{{}}' WHEN '{{' THEN '\\{{' WHEN '}}' THEN '\\}}' WHEN '#' THEN '\\#' WHEN '$' THEN '\\$' WHEN '%' THEN '\\%' WHEN '&' THEN '\\&' WHEN '_' THEN '\\_' ELSE c END), '')"


@query("c04_escape_latex", f"""SELECT doc_id, {LATEX_SQL.format(s='s')} AS latex,
  array_to_string(list_transform(string_split(s, ''), lambda c: CASE c WHEN '\\' THEN '\\textbackslash{{}}' WHEN '{{' THEN '\\{{' WHEN '}}' THEN '\\}}' ELSE c END), '') AS verbatim FROM {DOCS}""")
def latex(spark, d):
    return documents(spark, d).select("doc_id", t.escape_latex(F.col("s")).alias("latex"), t.escape_latex(F.col("s"), verbatim=True).alias("verbatim"))


@query("c05_unescape_latex", f"SELECT doc_id, s AS plain FROM {DOCS}")
def unlatex(spark, d):
    return documents(spark, d).select("doc_id", t.unescape_latex(t.escape_latex(F.col("s"))).alias("plain"))


@query("c06_escape_typst", f"""SELECT doc_id, array_to_string(list_transform(string_split(s, ''), lambda c: CASE WHEN c IN ('\\', '*', '_', '`', '$', '#', '@', '<', '>') THEN '\\' || c ELSE c END), '') AS typst,
  array_to_string(list_transform(string_split(s, ''), lambda c: CASE WHEN c IN ('\\', '"') THEN '\\' || c ELSE c END), '') AS url FROM {DOCS}""")
def typst(spark, d):
    return documents(spark, d).select("doc_id", t.escape_typst(F.col("s")).alias("typst"), t.escape_typst_url(F.col("s")).alias("url"))


@query("c07_escape_label", "SELECT p_partkey, regexp_replace(p_brand || ' ' || p_name || ':v1.2', '[^\\p{L}\\p{N}:.-]', '-', 'g') AS label FROM part")
def labels(spark, d):
    return part(spark, d).select("p_partkey", t.escape_label(F.concat("p_brand", F.lit(" "), "p_name", F.lit(":v1.2"))).alias("label"))


@query("c08_yaml_xml_escape", f"""SELECT doc_id, replace(replace(s, '\\', '\\\\'), '"', '\\"') AS yaml,
  replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml FROM {DOCS}""")
def yaml(spark, d):
    return documents(spark, d).select("doc_id", t.escape_yaml(F.col("s")).alias("yaml"), t.escape_xml(F.col("s")).alias("xml"))


CODE = "p_name || repeat('`', p_size % 6) || p_type"


@query("c09_code_fence", f"""SELECT p_partkey, repeat('`', greatest(p_size % 6, 2) + 1) AS fence,
  CASE WHEN p_size % 6 = 0 THEN '`' || {CODE} || '`' ELSE repeat('`', p_size % 6 + 1) || ' ' || {CODE} || ' ' || repeat('`', p_size % 6 + 1) END AS span FROM part""")
def fences(spark, d):
    code = F.concat("p_name", F.repeat(F.lit("`"), F.col("p_size") % 6), "p_type")
    return part(spark, d).select("p_partkey", t.code_fence(code).alias("fence"), t.code_span(code).alias("span"))


def attr_block(spark, d):
    """Attribute blocks of parts: every seventh has a token that is none."""
    bad = F.when(F.col("p_partkey") % 7 == 0, " stray").otherwise("")
    block = F.concat(F.lit("{#p"), F.col("p_partkey"), F.lit(" ."), F.lower("p_type"), F.lit(' size='), F.col("p_size"), F.lit(' name="'), F.col("p_name"), F.lit('"'), bad, F.lit("}"))
    return part(spark, d).withColumn("block", block)


@query("c10_parse_attrs", """SELECT p_partkey, p_partkey % 7 = 0 AS is_bad, CASE WHEN p_partkey % 7 != 0 THEN 'p' || p_partkey END AS id, CASE WHEN p_partkey % 7 != 0 THEN lower(p_type) END AS classes,
  CASE WHEN p_partkey % 7 != 0 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_partkey % 7 != 0 THEN p_name END AS name FROM part""")
def attrs(spark, d):
    a = attr_block(spark, d).withColumn("a", t.parse_attrs(F.col("block")))
    return a.select("p_partkey", F.col("a").isNull().alias("is_bad"), "a.id", F.array_join("a.classes", " ").alias("classes"), F.col("a.kv")["size"].alias("size"), F.col("a.kv")["name"].alias("name"))


@query("c11_trailing_attrs", """SELECT p_partkey, CASE WHEN p_partkey % 7 != 0 THEN p_name ELSE p_name || '  {#p' || p_partkey || ' .' || lower(p_type) || ' size=' || p_size || ' name=“' || p_name || '” stray}' END AS text,
  CASE WHEN p_partkey % 7 != 0 THEN 'p' || p_partkey END AS id, CASE WHEN p_partkey % 7 != 0 THEN p_name END AS name FROM part""")
def trailing(spark, d):
    heading = F.concat("p_name", F.lit("  "), F.regexp_replace("block", '="([^"]*)"', "=“$1”"))
    a = attr_block(spark, d).withColumn("a", t.trailing_attrs(heading))
    return a.select("p_partkey", "a.text", "a.attrs.id", F.col("a.attrs.kv")["name"].alias("name"))


@query("c12_code_info", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN NULL ELSE 'py' END AS language, CASE p_partkey % 3 WHEN 1 THEN 'html' END AS raw FROM part""")
def info(spark, d):
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lower("p_type"), F.lit(" rest"))).when(F.col("p_partkey") % 3 == 1, "{=html}").otherwise("{.py .numberLines startFrom=3}")
    return part(spark, d).withColumn("i", t.code_info(said)).select("p_partkey", "i.language", "i.raw")


@query("c18_override_metadata", """SELECT event_id, CASE event_type WHEN 'click' THEN 'T' || event_id ELSE 'old' END AS title, CASE WHEN event_type != 'click' THEN event_type END AS custom_key,
  CASE WHEN event_type != 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'a=b' ELSE '' END END AS custom_value FROM events""")
def overrides(spark, d):
    from leafmill.operators.metadata import override_metadata

    e = spark.read.parquet(f"{d}/events.parquet")
    pair = F.when(F.col("event_type") == "click", F.concat(F.lit("title=T"), F.col("event_id"))).otherwise(F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "=a=b").otherwise("=")))
    docs = e.select("event_id", F.lit("old").alias("title"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("abstract"), F.create_map().cast("map<string,string>").alias("custom"), F.array(pair).alias("pairs"))
    out = override_metadata(docs, "pairs")
    return out.select("event_id", "title", F.try_element_at(F.map_keys("custom"), F.lit(1)).alias("custom_key"), F.try_element_at(F.map_values("custom"), F.lit(1)).alias("custom_value"))


@query("c19_shift_headings", "SELECT p_partkey, least(6, greatest(1, p_size % 6 + 1 + CAST(p_partkey % 9 AS INTEGER) - 4)) AS level FROM part")
def shift(spark, d):
    return part(spark, d).select("p_partkey", t.shift_heading(F.col("p_size") % 6 + 1, (F.col("p_partkey") % 9 - 4).cast("int")).alias("level"))


def media(spark, d):
    """Images as bytes: PNG headers with the part's size and key as sides, JPEG starts, and neither."""
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), F.unhex(F.lpad(F.hex("p_size"), 8, "0")), F.unhex(F.lpad(F.hex("p_partkey"), 8, "0")))
    data = F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.encode("p_name", "utf-8"))
    return part(spark, d).withColumn("data", data)


@query("c20_detect_mime", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' END AS mime FROM part")
def mimes(spark, d):
    return media(spark, d).select("p_partkey", t.image_mime(F.col("data")).alias("mime"))


@query("c21_image_dimensions", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS BIGINT) END AS width, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS height FROM part")
def dimensions(spark, d):
    return media(spark, d).select("p_partkey", t.png_size(F.col("data")).alias("s")).select("p_partkey", "s.width", "s.height")


@query("c22_embed_image", """SELECT l_orderkey, l_linenumber, CASE WHEN p_partkey IS NOT NULL THEN 'data:text/plain;base64,' || to_base64(encode(p_name)) ELSE 'img/' || l_partkey || '.png' END AS src
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 5 != 0""")
def embedded(spark, d):
    from leafmill.operators.media import embed_images

    images = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.concat(F.lit("img/"), F.col("l_partkey"), F.lit(".png")).alias("url"))
    resources = part(spark, d).where("p_partkey % 5 != 0").select(F.concat(F.lit("img/"), F.col("p_partkey"), F.lit(".png")).alias("path"), F.lit("text/plain").alias("mime"), F.encode("p_name", "utf-8").alias("data"))
    return embed_images(images, resources).select("l_orderkey", "l_linenumber", "src")


@query("c23_css_dimensions", r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\textwidth' WHEN 1 THEN regexp_replace(CAST(CAST(p_size AS DOUBLE) / 100 AS VARCHAR), '\.0$', '') || '\textwidth' WHEN 2 THEN p_size || 'cm' END AS width,
  CASE p_partkey % 4 WHEN 0 THEN '[width=\textwidth,height=\textheight,keepaspectratio]' WHEN 1 THEN '[width=' || regexp_replace(CAST(CAST(p_size AS DOUBLE) / 100 AS VARCHAR), '\.0$', '') || '\textwidth,height=\textheight,keepaspectratio]' WHEN 2 THEN '[width=' || p_size || 'cm,height=3in,keepaspectratio]' ELSE '' END AS options FROM part""")
def css(spark, d):
    said = F.when(F.col("p_partkey") % 4 == 0, "100%").when(F.col("p_partkey") % 4 == 1, F.concat(F.col("p_size"), F.lit("%"))).otherwise(F.concat(F.col("p_size"), F.lit("cm")))
    one = F.create_map(F.lit("width"), said)
    kv = F.when(F.col("p_partkey") % 4 == 3, F.create_map().cast("map<string,string>")).when(F.col("p_partkey") % 4 == 2, F.map_concat(one, F.create_map(F.lit("height"), F.lit("3in")))).otherwise(one)
    p = part(spark, d).withColumn("kv", kv)
    return p.select("p_partkey", t.css_to_latex(F.try_element_at("kv", F.lit("width")), "width").alias("width"), t.includegraphics_options(F.col("kv")).alias("options"))


@query("c24_strip_number", "SELECT p_partkey, p_name AS title FROM part")
def stripped(spark, d):
    return part(spark, d).select("p_partkey", t.strip_number(F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey"), F.lit(" "), F.col("p_name"))).alias("title"))


@query("c25_line_ranges", "SELECT p_partkey, 2 AS n, CAST(p_size + p_size + p_size % 5 AS BIGINT) AS total FROM part")
def ranges(spark, d):
    said = F.concat(F.col("p_size"), F.lit(", x, 3-, "), F.col("p_size"), F.lit(" - "), F.col("p_size") + F.col("p_size") % 5)
    r = part(spark, d).withColumn("r", t.line_ranges(said))
    return r.select("p_partkey", F.size("r").alias("n"), (F.element_at("r", 1)["lo"] + F.element_at("r", 2)["hi"]).alias("total"))


@query("c26_list_marker", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN (l_orderkey % 10 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) || '. ' ELSE '- ' END ||
  CASE l_returnflag WHEN 'A' THEN '[x] ' WHEN 'R' THEN '[ ] ' ELSE '' END AS marker FROM lineitem""")
def markers(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    checked = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False)
    items = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("i", i)
    return items.select("l_orderkey", "l_linenumber", "l_partkey", t.list_marker(F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 10, F.col("i"), checked).alias("marker"))


@query("c27_alignment_css", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' ELSE 'left' END AS css FROM part")
def alignment(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("left", "center", "right", "default")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part(spark, d).select("p_partkey", t.entry(t.ALIGNMENT, name).alias("css"))
