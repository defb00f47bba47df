"""Outline queries: customers are documents, their orders the blocks, line items smaller parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as t
from leafmill.operators import outline as o

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """Two of three orders are headings; the others figures, tables, equations and code, some without label."""
    k = F.col("o_orderkey")
    other = F.element_at(F.array(*map(F.lit, ("figure", "table", "equation", "code"))), (F.floor(k / 3) % 4 + 1).cast("int"))
    kind = F.when(k % 3 != 0, "heading").otherwise(other)
    ident = F.when(k % 3 != 0, F.when(k % 5 != 0, F.concat(F.lit("h"), k % 40))).otherwise(F.when(k % 4 != 0, F.concat(F.lit("l"), k % 30)))
    return spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_custkey").alias("doc_id"), k.alias("pos"), kind.alias("kind"), F.when(k % 3 != 0, (k % 7 % 4 + 1).cast("int")).alias("level"), ident.alias("ident"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text")
    )


B = """(SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderkey % 3 != 0 THEN 'heading' ELSE ['figure', 'table', 'equation', 'code'][o_orderkey // 3 % 4 + 1] END AS kind,
  CASE WHEN o_orderkey % 3 != 0 THEN CAST(o_orderkey % 7 % 4 + 1 AS INTEGER) END AS level,
  CASE WHEN o_orderkey % 3 != 0 THEN CASE WHEN o_orderkey % 5 != 0 THEN 'h' || o_orderkey % 40 END ELSE CASE WHEN o_orderkey % 4 != 0 THEN 'l' || o_orderkey % 30 END END AS ident,
  o_orderpriority || ' ' || o_orderstatus AS text FROM orders)"""
WITH_B = f"WITH b AS MATERIALIZED {B}, h AS (SELECT * FROM b WHERE kind = 'heading')"


def headings(spark, d):
    return blocks(spark, d).where("kind = 'heading'")


def counter(k: int) -> str:
    return f"(SELECT count(*) FROM h x WHERE x.doc_id = h.doc_id AND x.level = {k} AND x.pos <= h.pos AND x.pos > coalesce((SELECT max(y.pos) FROM h y WHERE y.doc_id = h.doc_id AND y.level < {k} AND y.pos <= h.pos), -1))"


@query("f1_number_sections", WITH_B + f" SELECT doc_id, pos, CASE WHEN level = 1 THEN 'Chapter ' || {counter(1)} ELSE array_to_string([{', '.join(counter(k) for k in range(1, 5))}][1:level], '.') END AS number FROM h")
def f1(spark, d):
    return o.number_sections(headings(spark, d), top="Chapter").select("doc_id", "pos", "number")


NUMBERED = "n AS (SELECT doc_id, pos, ident, CASE kind WHEN 'heading' THEN 'section' ELSE kind END AS label_kind, (SELECT count(*) FROM b x WHERE x.doc_id = b.doc_id AND x.kind = b.kind AND x.ident IS NOT NULL AND x.pos <= b.pos) AS number FROM b WHERE ident IS NOT NULL)"
INDEX = "i AS (SELECT doc_id, ident AS label, arg_max(label_kind, pos) AS label_kind, arg_max(number, pos) AS number FROM n GROUP BY doc_id, ident)"


@query("f2_number_labels", f"{WITH_B}, {NUMBERED} SELECT * FROM n")
def f2(spark, d):
    return o.number_labels(blocks(spark, d)).select("doc_id", "pos", "ident", "label_kind", "number")


@query("e5_label_index", f"{WITH_B}, {NUMBERED}, {INDEX} SELECT * FROM i")
def e5(spark, d):
    return o.label_index(o.number_labels(blocks(spark, d)))


def refs(spark, d):
    """Line items refer to labels of their order's customer."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").join(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc_id")), "l_orderkey")
    form = F.element_at(F.array(*map(F.lit, ("number", "number_with_type", "page", "custom"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    target = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("h"), F.col("l_partkey") % 40)).otherwise(F.concat(F.lit("l"), F.col("l_partkey") % 30))
    return li.select("doc_id", "l_orderkey", "l_linenumber", "l_partkey", target.alias("target"), form.alias("form"), F.lower("l_returnflag").alias("custom_text"))


R = "r AS (SELECT o_custkey AS doc_id, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN 'h' || l_partkey % 40 ELSE 'l' || l_partkey % 30 END AS target, l_linenumber % 4 AS form, lower(l_returnflag) AS custom_text FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query("d1_resolve_crossrefs", f"""{WITH_B}, {NUMBERED}, {INDEX}, {R} SELECT r.doc_id, l_orderkey, l_linenumber, l_partkey, target,
  CASE form WHEN 1 THEN CASE label_kind WHEN 'code' THEN 'Listing' ELSE upper(label_kind[1]) || label_kind[2:] END || ' ' || number WHEN 3 THEN custom_text || ' ' || number ELSE CAST(number AS VARCHAR) END AS text
  FROM r LEFT JOIN i ON i.doc_id = r.doc_id AND i.label = r.target""")
def d1(spark, d):
    return o.resolve_crossrefs(refs(spark, d), o.label_index(o.number_labels(blocks(spark, d)))).select("doc_id", "l_orderkey", "l_linenumber", "l_partkey", "target", "text")


@query("g5_unresolved_refs", f"{WITH_B}, {R} SELECT doc_id, target, count(*) AS n FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = r.doc_id AND b.ident = r.target) GROUP BY doc_id, target")
def g5(spark, d):
    labels = o.label_index(o.number_labels(blocks(spark, d)))
    return o.unresolved(refs(spark, d), labels).groupBy("doc_id", "target").agg(F.count("*").alias("n"))


@query("f5_section_tree", f"""{WITH_B} SELECT doc_id, pos, (SELECT max(x.pos) FROM h x WHERE x.doc_id = h.doc_id AND x.pos < h.pos AND x.level < h.level) AS parent,
  (SELECT min(x.pos) FROM h x WHERE x.doc_id = h.doc_id AND x.pos > h.pos AND x.level <= h.level) AS until FROM h""")
def f5(spark, d):
    return o.section_tree(headings(spark, d)).select("doc_id", "pos", "parent", "until")


@query("d8_section_membership", f"{WITH_B} SELECT doc_id, pos, (SELECT max(x.pos) FROM h x WHERE x.doc_id = b.doc_id AND x.pos <= b.pos) AS section FROM b")
def d8(spark, d):
    return o.section_membership(blocks(spark, d)).select("doc_id", "pos", "section")


SLUG = "CASE WHEN o_orderkey % 6 = 0 THEN 'a-1' WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' || o_orderkey % 3 END"


@query("f3_dedup_ids", f"""WITH RECURSIVE s AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, {SLUG} AS slug, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
f(doc_id, rn, seen) AS (SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM s GROUP BY doc_id UNION ALL
  SELECT s.doc_id, s.rn, list_append(f.seen, list_filter(list_transform(range(0, len(f.seen) + 1), lambda k: CASE WHEN k = 0 THEN s.slug ELSE s.slug || '-' || k END), lambda c: NOT list_contains(f.seen, c))[1]) FROM f JOIN s ON s.doc_id = f.doc_id AND s.rn = f.rn + 1)
SELECT s.doc_id, s.pos, s.slug, f.seen[-1] AS id FROM s JOIN f USING (doc_id, rn)""")
def f3(spark, d):
    k = F.col("o_orderkey")
    slug = F.when(k % 6 == 0, "a-1").when(k % 2 == 0, "a").otherwise(F.concat(F.lit("b"), k % 3))
    return o.dedup_ids(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), slug.alias("slug")))


@query("f4_toc_tree", f"""{WITH_B.replace('WITH b', 'WITH RECURSIVE b')}, s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM h WHERE ident IS NOT NULL AND level <= 3),
f(doc_id, rn, stack, dead, pos, level, kept) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(level INTEGER, pos BIGINT)[]), false, CAST(NULL AS BIGINT), CAST(NULL AS INTEGER), false FROM s GROUP BY doc_id UNION ALL
  SELECT doc_id, rn, CASE WHEN len(old) > 0 AND len(under) = 0 THEN [{{'level': 0, 'pos': CAST(-1 AS BIGINT)}}] WHEN lost THEN under ELSE list_append(list_filter(under, lambda x: x.level < level), {{'level': level, 'pos': pos}}) END, lost, pos, level, NOT lost
  FROM (SELECT *, len(old) > 0 AND (len(under) = 0 OR (under[-1].level != level AND (len(under) < len(old) OR dead))) AS lost
        FROM (SELECT s.doc_id, s.rn, s.pos, s.level, f.dead, f.stack AS old, list_filter(f.stack, lambda x: x.level <= s.level) AS under FROM f JOIN s ON s.doc_id = f.doc_id AND s.rn = f.rn + 1)))
SELECT f.doc_id, f.pos, CAST(len(stack) - 1 AS INTEGER) AS nesting, CASE WHEN len(stack) > 1 THEN stack[-2].pos END AS parent, '#' || s.ident AS url FROM f JOIN s ON s.doc_id = f.doc_id AND s.rn = f.rn WHERE kept""")
def f4(spark, d):
    return o.toc_tree(headings(spark, d).withColumnRenamed("ident", "id"), depth=3)


def paragraphs(spark, d):
    """Lines of an order: tables, captions and other paragraphs."""
    k = F.col("l_partkey")
    kind = F.when(k % 3 == 0, "table").otherwise("paragraph")
    text = F.when(k % 3 == 1, F.concat(F.when(k % 2 == 0, "Table:  ").otherwise(": "), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("Tables "), F.col("l_suppkey")))
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x")).select("doc_id", "pos", "x.*")
    return li.select("doc_id", "pos", kind.alias("kind"), F.when(k % 3 == 0, F.lit("")).otherwise(text).alias("text"))


@query("f6_table_captions", """WITH x AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, min((l_partkey, l_suppkey)) AS m FROM lineitem GROUP BY ALL), p AS (SELECT doc_id, pos, m[1] AS k, m[2] AS s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM x),
above AS (SELECT t.doc_id, t.rn, c.rn AS used, CAST(c.s AS VARCHAR) AS caption FROM p t JOIN p c ON c.doc_id = t.doc_id AND c.rn = t.rn - 1 WHERE t.k % 3 = 0 AND c.k % 3 = 1),
below AS (SELECT t.doc_id, t.rn, c.rn AS used, CAST(c.s AS VARCHAR) AS caption FROM p t JOIN p c ON c.doc_id = t.doc_id AND c.rn = t.rn + 1 WHERE t.k % 3 = 0 AND c.k % 3 = 1
  AND NOT EXISTS (SELECT 1 FROM above a WHERE a.doc_id = t.doc_id AND a.rn = t.rn) AND NOT EXISTS (SELECT 1 FROM above a WHERE a.doc_id = t.doc_id AND a.used = c.rn)),
allc AS (SELECT * FROM above UNION ALL SELECT * FROM below)
SELECT p.doc_id, p.pos, CASE WHEN p.k % 3 = 0 THEN 'table' ELSE 'paragraph' END AS kind, allc.caption FROM p LEFT JOIN allc ON allc.doc_id = p.doc_id AND allc.rn = p.rn WHERE NOT EXISTS (SELECT 1 FROM allc u WHERE u.doc_id = p.doc_id AND u.used = p.rn)""")
def f6(spark, d):
    return o.table_captions(paragraphs(spark, d)).select("doc_id", "pos", "kind", "caption")


def notes(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.when(k % 4 == 0, F.concat(F.lit("n"), k % 6)).alias("id"), F.when(k % 5 == 0, 1).otherwise(0).alias("depth"), F.col("o_orderpriority").alias("text"))


@query("f7_footnote_counter", "SELECT o_custkey AS doc_id, o_orderkey AS pos, CASE WHEN o_orderkey % 4 = 0 THEN 'n' || o_orderkey % 6 ELSE 'fn' || (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey <= o.o_orderkey AND x.o_orderkey % 4 != 0) END AS id FROM orders o")
def f7(spark, d):
    return o.footnote_counter(notes(spark, d)).select("doc_id", "pos", "id")


@query("d5_footnote_join", """WITH n AS (SELECT o_custkey AS doc_id, 'n' || o_orderkey % 6 AS id, arg_max(o_orderpriority, o_orderkey) AS note FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 5 != 0 GROUP BY ALL)
SELECT o_custkey AS doc_id, o_orderkey AS pos, 'n' || o_orderkey % 6 AS id, note FROM orders LEFT JOIN n ON n.doc_id = o_custkey AND n.id = 'n' || o_orderkey % 6""")
def d5(spark, d):
    k = F.col("o_orderkey")
    refs = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), k.alias("pos"), F.concat(F.lit("n"), k % 6).alias("id"))
    return o.footnote_join(refs, notes(spark, d).where("id IS NOT NULL"))


@query("e8_footnote_numbers", "SELECT o_custkey AS doc_id, o_orderkey AS pos, (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey <= o.o_orderkey AND x.o_orderkey % 5 != 0) + 1 AS number FROM orders o WHERE o_orderkey % 5 != 0")
def e8(spark, d):
    return o.note_numbers(notes(spark, d)).select("doc_id", "pos", F.col("number").cast("long").alias("number"))


CODE = "SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents"


def code(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    said = F.concat((F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), (F.col("doc_id") % 3 + 2).cast("string"), F.lit(",7"))
    return docs.select("doc_id", F.lit(0).alias("pos"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 10).alias("start"), t.line_ranges(said).alias("ranges"))


@query("f8_line_numbers", f"SELECT doc_id, line_no, doc_id % 10 + line_no - 1 AS number, ls[line_no] AS line FROM (SELECT doc_id, ls, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_no FROM ({CODE}))")
def f8(spark, d):
    return o.code_lines(code(spark, d)).select("doc_id", "line_no", "number", "line")


@query("d9_highlighted_lines", f"SELECT doc_id, line_no FROM (SELECT doc_id, ls, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_no FROM ({CODE})) WHERE line_no = 7 OR line_no BETWEEN doc_id % 3 + 1 AND doc_id % 3 + 2")
def d9(spark, d):
    return o.code_lines(code(spark, d)).where("highlighted").select("doc_id", "line_no")
