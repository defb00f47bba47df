"""Documents as one tree of tagged objects in JSON, which Spark reads back as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.inlines import let
from leafmill.functions.yaml import json_string
from leafmill.operators.documents import from_deepest

#: Tags of blocks and inlines by kind; the tag of any other kind is its words, each with a capital.
TAGS = {
    "code": "CodeBlock", "math": "MathBlock", "blockquote": "BlockQuote", "rule": "ThematicBreak", "raw": "RawBlock", "footnote": "FootnoteDef", "item": "ListItem", "description_list": "DefinitionList",
}
INLINE_TAGS = {"math": "MathInline", "raw": "RawInline", "crossref": "CrossRef", "single_quoted": "Quoted"}
#: Inlines with nothing inside but a value, by the name of that value; all others have content.
VALUES = {"text": "value", "code": "value", "math": "value", "raw": "content", "footnote_ref": "id", "crossref": "target", "citation": "source"}
#: Blocks whose content is a text; those with inlines; all others hold blocks.
TEXTS, LEAVES = ["code", "math", "raw"], ["paragraph", "heading"]


def tag(kind: Column, known: dict[str, str]) -> Column:
    named = F.replace(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    for k, name in known.items():
        named = F.when(kind == k, name).otherwise(named)
    return named


def inlines_json(inlines: Column | str) -> Column:
    """An array of inline events as a JSON array of nested objects; null is an empty one."""

    def one(e: Column, before: Column) -> Column:
        kind = F.regexp_replace(e["kind"], "^/", "")
        ends, begins = e["kind"].startswith("/"), e["value"].isNull() & ~kind.isin("soft_break", "hard_break", *VALUES)
        fields = [
            tag(kind, INLINE_TAGS).alias("type"), F.when(kind == "quoted", "DoubleQuote").when(kind == "single_quoted", "SingleQuote").alias("quote_type"), F.when(kind.isin("link", "image"), e["url"]).alias("url"),
            F.when(kind.isin("link", "image"), e["title"]).alias("title"), F.when(kind == "raw", e["url"]).alias("format"), *[F.when(kind.isin(*[k for k, v in VALUES.items() if v == n]), e["value"]).alias(n) for n in dict.fromkeys(VALUES.values())],
        ]
        head = F.to_json(F.struct(*fields))
        opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.when(kind == "image", ',"alt":[').otherwise(',"content":['))
        inner = F.when(e["value"] != "", F.concat(F.lit('{"type":"Text","value":'), json_string(e["value"]), F.lit("}"))).otherwise("")
        said = F.when(ends, "]}").when(begins, opened).when(kind.isin("soft_break", "hard_break", *VALUES), head).otherwise(F.concat(opened, inner, F.lit("]}")))
        first = before.isNull() | (before["value"].isNull() & ~before["kind"].startswith("/") & ~before["kind"].isin("soft_break", "hard_break", *VALUES))
        return F.concat(F.when(ends | first, "").otherwise(","), said)

    body = let(inlines, lambda es: F.array_join(F.transform(es, lambda e, i: one(e, F.when(i > 0, F.get(es, i - 1)))), ""))
    return F.concat(F.lit("["), F.coalesce(body, F.lit("")), F.lit("]"))


def tree_json(blocks: DataFrame) -> DataFrame:
    """(doc_id, json): the blocks of each document, as the readers make them, as one JSON object {"content": [...]}.

    Each block has its tag as type, what it has of level, id, language, order, start, and its inlines, text or blocks as
    content; items of lists are in items, cells of a table in cells, its caption beside them. What is null is left out.
    """
    for name, kind in (("classes", "array<string>"), ("tight", "boolean"), ("url", "string"), ("title", "string"), ("cells", "array<struct<section:string,row:int,col:int,text:string,colspan:int,rowspan:int,align:string,inlines:array<struct<kind:string,value:string,url:string,title:string>>>>")):
        if name not in blocks.columns:
            blocks = blocks.withColumn(name, F.lit(None).cast(kind))
    kind = F.col("kind")
    only = lambda name, *kinds: F.when(kind.isin(*kinds), F.col(name)).alias(name)
    head = F.to_json(F.struct(
        tag(kind, TAGS).alias("type"), only("level", "heading"), F.col("ident").alias("id"), F.when(kind == "code", F.col("language")).alias("language"), F.when(kind == "raw", F.col("language")).alias("format"), only("ordered", "list"),
        F.when((kind == "list") & F.col("ordered"), F.col("start")).alias("start"), only("tight", "list"), only("checked", "item"), F.col("classes"), F.col("url"), F.col("title"),
    ))
    cell = lambda c: F.concat(F.lit('{"section":'), json_string(c["section"]), F.lit(',"row":'), c["row"].cast("string"), F.lit(',"col":'), c["col"].cast("string"), F.when(c["align"].isNotNull(), F.concat(F.lit(',"align":'), json_string(c["align"]))).otherwise(""), F.lit(',"content":'), inlines_json(c["inlines"]), F.lit("}"))
    cells = F.concat(F.lit("["), F.array_join(F.transform("cells", cell), ","), F.lit("]"))
    content = F.when(kind.isin(*TEXTS), json_string(F.coalesce("text", F.lit("")))).when(kind == "table", F.coalesce(cells, F.lit("[]"))).when(kind.isin(*LEAVES), inlines_json("inlines"))
    caption = F.when((kind == "table") & (F.size("inlines") > 0), F.concat(F.lit(',"caption":'), inlines_json("inlines"))).otherwise("")
    rows = blocks.select("doc_id", "pos", "parent", "depth", "kind", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), caption).alias("head"), content.alias("leaf"), F.lit("").alias("content"))
    name = F.when(kind == "list", "items").when(kind == "table", "cells").otherwise("content")
    inside = F.coalesce("leaf", F.concat(F.lit("["), "content", F.lit("]")))
    block = F.concat("head", F.when(kind == "rule", "").otherwise(F.concat(F.lit(',"'), name, F.lit('":'), inside)), F.lit("}"))
    return from_deepest(rows, block, F.lit(",")).select("doc_id", F.concat(F.lit('{"content":['), "text", F.lit("]}")).alias("json"))
