"""DOCX packages: bytes to blocks, and the tables of their parts joined and numbered."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "array<struct<pos:int,style:string,text:string,bold:boolean,italic:boolean,in_table:boolean>>"


def read_package(data: bytes | None) -> list[dict]:
    """Paragraphs of a package's main part in order; none if it cannot be read."""
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data or b"")).read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    tables = {p for t in root.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
    out = []
    for p in root.iter(f"{W}p"):
        style = p.find(f"{W}pPr/{W}pStyle")
        runs = list(p.iter(f"{W}r"))
        text = "".join((t.text or "") if t.tag == f"{W}t" else "\n" if t.tag == f"{W}br" else "\t" for r in runs for t in r if t.tag in (f"{W}t", f"{W}br", f"{W}tab"))
        has = lambda n, runs=runs: bool(runs) and all(r.find(f"{W}rPr/{W}{n}") is not None for r in runs)
        out.append({"pos": len(out), "style": None if style is None else style.get(f"{W}val"), "text": text, "bold": has("b"), "italic": has("i"), "in_table": p in tables})
    return out


def docx_blocks(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, style, text, bold, italic, in_table) of packages (key, data)."""
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        item = pa.struct([("pos", pa.int32()), ("style", pa.string()), ("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("in_table", pa.bool_())])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([read_package(d) for d in batch.column(1).to_pylist()], pa.list_(item))], names=[key, "blocks"])

    return files.select(key, "data").mapInArrow(run, f"{key} {kind}, blocks {BLOCKS}").select(key, F.inline("blocks"))


#: Style ids by what they stand for, what heading ids begin with, words in style names.
STYLE_IDS = {
    "title": ["title"], "author": ["author"], "date": ["date"], "abstract": ["abstract"], "caption": ["caption"],
    "code": ["codeblock", "code block", "sourcecode", "source code", "verbatim", "preformatted"],
    "quote": ["blockquote", "block quote", "blocktext", "block text"], "math": ["mathblock", "math block", "displaymath", "display math"],
}
HEADING_IDS = ["heading", "titre", "überschrift", "titulo", "título", "overskrift", "rubrik", "kap"]
STYLE_NAMES = {"code": ["code", "preformatted", "verbatim"], "quote": ["quote", "block text"], "abstract": ["abstract"], "caption": ["caption"]}


def style_kind(style: Column, outline: Column, name: Column | None = None) -> Column:
    """What a paragraph style stands for: heading1 .. heading6, code, quote, math, caption, title and so on, else normal.

    Its id decides if it is known, then a heading's id with its level, then the outline level, then words of its name.
    """
    s, said = F.lower(style), F.lower(style if name is None else name)
    level = F.regexp_extract(s, "^(?:" + "|".join(HEADING_IDS) + r")\+?0*([1-6])$", 1)
    found = F.lit(None).cast("string")
    for kind, ids in STYLE_IDS.items():
        found = F.when(s.isin(*ids), kind).otherwise(found)
    heading = F.contains(said, F.lit("heading")) | said.rlike("^h[123]")
    digit = F.when(said.rlike("(?:[1-6]$| [1-6])"), F.array_min(F.transform(F.regexp_extract_all(said, F.lit("(?:(?<= )[1-6]|[1-6]$)"), 0), lambda x: x.cast("int")))).otherwise(1)
    by_name = F.when(heading, F.concat(F.lit("heading"), digit.cast("string")))
    for kind, words in STYLE_NAMES.items():
        by_name = by_name.when(said.rlike("|".join(words)), kind)
    return F.coalesce(found, F.when(level != "", F.concat(F.lit("heading"), level)), F.when(outline.between(0, 5), F.concat(F.lit("heading"), (outline + 1).cast("string"))), by_name, F.lit("normal"))


def numbering_formats(nums: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, num_id, level, ordered, format) by way of the abstract numbering: nums (doc_id, num_id, abstract_id), levels (doc_id, abstract_id, level, format)."""
    return nums.join(levels, ["doc_id", "abstract_id"]).select("doc_id", "num_id", "level", (~F.col("format").isin("bullet", "none")).alias("ordered"), "format")


def relationships(runs: DataFrame, rels: DataFrame) -> DataFrame:
    """Runs (doc_id, r_id) with target and kind (link, image or other) of their relationship (doc_id, r_id, type, target)."""
    kind = F.when(F.endswith("type", F.lit("/hyperlink")), "link").when(F.endswith("type", F.lit("/image")), "image").otherwise("other")
    return runs.join(rels.withColumn("kind", kind).drop("type"), ["doc_id", "r_id"], "left")


def merged_cells(cells: DataFrame) -> DataFrame:
    """Cells (doc_id, row, col, text, vmerge) with rowspan: a cell that continues adds to the last one that restarts above it and goes."""
    w = Window.partitionBy("doc_id", "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    starts = ~F.coalesce(F.col("vmerge") == "continue", F.lit(False))
    g = cells.withColumn("_g", F.sum(starts.cast("int")).over(w))
    return g.groupBy("doc_id", "col", "_g").agg(F.min("row").alias("row"), F.min_by("text", "row").alias("text"), F.count("*").cast("int").alias("rowspan")).where("_g > 0").drop("_g")


def package_metadata(core: DataFrame) -> DataFrame:
    """Adds authors and keywords to core properties: creators split at ;, subject and keywords as one list split at ; or else at commas."""
    words = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), F.when(F.contains(F.coalesce(c, F.lit("")), F.lit(";")), ";").otherwise(",")), lambda x: F.trim(x)), lambda x: x != "")
    return core.withColumns({"authors": F.filter(F.transform(F.split("creator", ";"), lambda x: F.trim(x)), lambda x: x != ""), "words": F.array_distinct(F.concat(words(F.col("subject")), words(F.col("keywords"))))})


# ---- Whole packages ---------------------------------------------------------------------------------

R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: One row of a package: what it is, where it stands, and what it says. The tables of `Package` are filters of these.
PART = "struct<part:string,pos:int,n:int,id:string,text:string,style:string,ref:string,level:int,table:int,row:int,col:int,span:int,flags:array<string>>"
PLACE = 64


def _parts(data: bytes | None) -> list[dict]:
    """The rows of a package: paragraphs, runs, cells, relationships, numberings, styles and notes; one of part error if it cannot be read."""
    try:
        package = zipfile.ZipFile(io.BytesIO(data or b""))
        main = ElementTree.fromstring(package.read("word/document.xml"))
        more = {n: ElementTree.fromstring(package.read(f"word/{n}.xml")) for n in ("styles", "numbering", "footnotes", "endnotes") if f"word/{n}.xml" in package.namelist()}
        rels = ElementTree.fromstring(package.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in package.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return [{"part": "error", "text": f"no package: {e}"}]
    val = lambda e, path, name="val": None if (x := e.find(path)) is None else x.get(f"{W}{name}")
    number = lambda s: int(s) if (s or "").lstrip("-").isdigit() else None
    out: list[dict] = []

    def paragraph(p, where: dict) -> None:
        pos = len(out)
        pr = f"{W}pPr/"
        out.append({"part": "para", "pos": pos, "style": val(p, f"{pr}{W}pStyle"), "ref": val(p, f"{pr}{W}numPr/{W}numId"), "level": number(val(p, f"{pr}{W}numPr/{W}ilvl")), "span": number(val(p, f"{pr}{W}outlineLvl")), **where})
        for holder in p:
            inside = holder.iter(f"{W}r") if holder.tag == f"{W}hyperlink" else [holder] if holder.tag == f"{W}r" else holder.iter(f"{W}r")
            link = (holder.get(f"{R}id") or (f"#{holder.get(f'{W}anchor')}" if holder.get(f"{W}anchor") else None)) if holder.tag == f"{W}hyperlink" else None
            for r in inside:
                on = lambda n, r=r: (x := r.find(f"{W}rPr/{W}{n}")) is not None and x.get(f"{W}val") not in ("0", "false", "none")
                raised = val(r, f"{W}rPr/{W}vertAlign")
                flags = [k for n, k in (("b", "strong"), ("i", "emphasis"), ("strike", "strikethrough"), ("u", "underline"), ("smallCaps", "small_caps")) if on(n)] + ([raised] if raised in ("superscript", "subscript") else [])
                for t in r.iter():
                    kind = {f"{W}t": "text", f"{W}tab": "text", f"{W}br": "hard_break", f"{W}footnoteReference": "footnote_ref", f"{W}endnoteReference": "footnote_ref", "{http://schemas.openxmlformats.org/drawingml/2006/main}blip": "image"}.get(t.tag)
                    if kind:
                        said = {"text": t.text or "" if t.tag == f"{W}t" else "\t", "hard_break": "\n", "image": ""}.get(kind, t.get(f"{W}id"))
                        alt = next((d.get("descr") for d in r.iter() if d.tag.endswith("}docPr") and d.get("descr")), "") if kind == "image" else None
                        out.append({"part": "run", "pos": pos, "n": len(out), "style": kind, "text": alt if kind == "image" else said, "ref": t.get(f"{R}embed") if kind == "image" else link, "flags": [] if kind == "footnote_ref" else flags})

    def body(e, where: dict) -> None:
        for x in e:
            if x.tag == f"{W}p":
                paragraph(x, where)
            elif x.tag == f"{W}tbl":
                at = len(out)
                out.append({"part": "table", "pos": at, **({"id": where["id"]} if "id" in where else {})})
                for i, tr in enumerate(x.iter(f"{W}tr")):
                    col = 0
                    for tc in tr.findall(f"{W}tc"):
                        span = number(val(tc, f"{W}tcPr/{W}gridSpan")) or 1
                        merge = tc.find(f"{W}tcPr/{W}vMerge")
                        out.append({"part": "cell", "table": at, "row": i, "col": col, "span": span, "text": None if merge is None else merge.get(f"{W}val") or "continue"})
                        for p in tc.iter(f"{W}p"):
                            paragraph(p, {**where, "table": at, "row": i, "col": col})
                        col += span
            elif x.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins"):
                body(x, where)

    body(main.find(f"{W}body"), {})
    for name in ("footnotes", "endnotes"):
        for note in more.get(name, ()):
            if note.get(f"{W}type") is None:
                body(note, {"id": note.get(f"{W}id")})
    for s in more.get("styles", ()):
        if s.tag == f"{W}style":
            out.append({"part": "style", "id": s.get(f"{W}styleId"), "text": val(s, f"{W}name"), "level": number(val(s, f"{W}pPr/{W}outlineLvl"))})
    for x in more.get("numbering", ()):
        if x.tag == f"{W}num":
            out.append({"part": "num", "id": x.get(f"{W}numId"), "ref": val(x, f"{W}abstractNumId")})
        elif x.tag == f"{W}abstractNum":
            out += [{"part": "level", "ref": x.get(f"{W}abstractNumId"), "level": number(lv.get(f"{W}ilvl")), "text": val(lv, f"{W}numFmt")} for lv in x.findall(f"{W}lvl")]
    for x in rels if rels is not None else ():
        out.append({"part": "rel", "id": x.get("Id"), "style": x.get("Type"), "text": x.get("Target")})
    return out


def package_parts(files: DataFrame) -> DataFrame:
    """(doc_id, part, ...) of packages (doc_id, data): one read of each, all of its tables as tagged rows."""
    kind = dict(files.dtypes)["doc_id"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        text, number = ("part", "id", "text", "style", "ref"), ("pos", "n", "level", "table", "row", "col", "span")
        order = ["part", "pos", "n", "id", "text", "style", "ref", "level", "table", "row", "col", "span", "flags"]
        item = pa.struct([(f, pa.string() if f in text else pa.int32() if f in number else pa.list_(pa.string())) for f in order])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_parts(d) for d in batch.column(1).to_pylist()], pa.list_(item))], names=["doc_id", "parts"])

    return files.select("doc_id", "data").mapInArrow(run, f"doc_id {kind}, parts array<{PART}>").select("doc_id", F.inline("parts"))


def run_inlines(runs: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, pos, inlines) of runs: neighbours of one look are one piece, marked up from the outside in; links and images have their targets."""
    from leafmill.functions.inlines import EVENT, event, folded, joined

    met = relationships(runs.withColumnRenamed("ref", "r_id"), rels.select("doc_id", F.col("id").alias("r_id"), F.col("style").alias("type"), F.col("text").alias("target")))
    url = F.coalesce("target", F.when(F.startswith("r_id", F.lit("#")), F.col("r_id")))
    looks = F.struct("n", F.col("style").alias("kind"), F.col("text").alias("value"), F.when(F.col("style") == "image", url).alias("url"), F.when((F.col("style") != "image") & F.col("r_id").isNotNull(), F.coalesce(url, F.lit(""))).alias("link"), "flags")
    rows = F.array_sort(F.collect_list(looks))
    path = lambda x: F.concat(F.when(x["link"].isNotNull(), F.array(F.struct(F.lit("link").alias("kind"), x["link"].alias("url")))).otherwise(F.array().cast("array<struct<kind:string,url:string>>")), F.transform(x["flags"], lambda f: F.struct(f.alias("kind"), F.lit(None).cast("string").alias("url"))))

    def woven(r: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            now, then = path(x), path(F.get(r, i - 1))
            before = F.when(i == 0, F.slice(now, 1, 0)).otherwise(then)
            shared = F.size(F.filter(now, lambda p, j: F.forall(F.transform(F.slice(now, F.lit(1), j + 1), lambda q, k: q.eqNullSafe(F.get(before, k))), lambda x: x)))
            ends = F.reverse(F.transform(F.slice(before, shared + 1, F.size(before)), lambda p: event(F.concat(F.lit("/"), p["kind"]), None, p["url"])))
            begins = F.transform(F.slice(now, shared + 1, F.size(now)), lambda p: event(p["kind"], None, p["url"]))
            return F.concat(ends, begins, F.array(event(x["kind"], x["value"], x["url"])))

        last = F.reverse(F.transform(path(F.try_element_at(r, F.lit(-1))), lambda p: event(F.concat(F.lit("/"), p["kind"]), None, p["url"])))
        return folded(joined(F.concat(F.flatten(F.transform(r, one)), last).cast(f"array<{EVENT}>")))

    return met.groupBy("doc_id", "pos").agg(rows.alias("r")).select("doc_id", "pos", woven(F.col("r")).alias("inlines"))


def docx_documents(files: DataFrame) -> DataFrame:
    """Blocks as renderers take them, with their inlines and cells, of packages (doc_id, data).

    Paragraphs get their kind from their style and outline level, their list from the numbering; links and images
    their target from the relationships; merged cells their spans. Notes come last. A package that cannot be read is
    one block of kind error; null and empty data too.
    """
    from leafmill.functions.inlines import event
    from leafmill.sources.notes import NOTES
    from leafmill.tables import Tables

    tables = Tables(files)
    parts = tables.stored(package_parts(files))
    of = lambda name: parts.where(F.col("part") == name)
    null = lambda kind: F.lit(None).cast(kind)
    styles = of("style").select("doc_id", F.col("id").alias("style"), F.col("text").alias("name"), F.col("level").alias("outline"))
    formats = numbering_formats(of("num").select("doc_id", F.col("id").alias("num_id"), F.col("ref").alias("abstract_id")), of("level").select("doc_id", F.col("ref").alias("abstract_id"), "level", F.col("text").alias("format"))).select("doc_id", F.col("num_id").alias("ref"), "level", "ordered")
    inlines = run_inlines(of("run").select("doc_id", "pos", "n", "style", "text", "ref", "flags"), of("rel"))
    paras = of("para").select("doc_id", "pos", "style", "ref", F.when(F.col("ref").isNotNull(), F.coalesce("level", F.lit(0))).alias("level"), F.col("span").alias("own"), "table", "row", "col", F.col("id").alias("note"))
    paras = paras.join(styles, ["doc_id", "style"], "left").join(formats, ["doc_id", "ref", "level"], "left").join(inlines, ["doc_id", "pos"], "left")
    said = F.coalesce("inlines", F.array().cast("array<struct<kind:string,value:string,url:string,title:string>>"))
    paras = tables.stored(paras.select("doc_id", "pos", style_kind(F.coalesce("style", F.lit("")), F.coalesce("own", "outline"), F.coalesce("name", "style", F.lit(""))).alias("stands"), F.when(F.col("ref") != "0", F.col("level")).alias("level"), F.coalesce("ordered", F.lit(False)).alias("ordered"), "table", "row", "col", "note", said.alias("inlines")))
    plain = F.array_join(F.transform("inlines", lambda x: F.coalesce(x["value"], F.lit(""))), "")
    # the body: paragraphs outside of tables and notes
    b = paras.where("table IS NULL AND note IS NULL AND stands NOT IN ('title', 'author', 'date', 'abstract')")
    kind = F.when(F.col("stands").startswith("heading"), "heading").when(F.col("stands").isin("code", "math"), F.col("stands")).when(F.col("stands") == "quote", "quote").when(F.col("level").isNotNull(), "item").otherwise("paragraph")
    b = b.withColumn("kind", kind).where((F.size("inlines") > 0) | (F.col("kind") == "item"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    # neighbours of one special kind are one block: lines of code, paragraphs of a quote, items of a list
    all_rows = b.select("doc_id", "pos", "kind").unionByName(of("table").where("id IS NULL").select("doc_id", "pos", F.lit("table").alias("kind")))
    runs = all_rows.withColumn("first", F.when(F.col("kind").isin("code", "quote", "item") & (F.lag("kind", 1, "").over(w) == F.col("kind")), null("int")).otherwise(F.col("pos"))).withColumn("home", F.last("first", True).over(w)).select("doc_id", "pos", "home")
    b = b.join(runs, ["doc_id", "pos"])
    at = lambda c, i=0: F.col(c).cast("long") * PLACE + i
    empty = {"parent": "long", "level": "int", "language": "string", "start": "int", "checked": "boolean", "text": "string", "ordered": "boolean", "index": "int", "ident": "string", "inlines": "array<struct<kind:string,value:string,url:string,title:string>>", "cells": "array<struct<section:string,row:int,col:int,text:string,colspan:int,rowspan:int,align:string,inlines:array<struct<kind:string,value:string,url:string,title:string>>>>"}
    full = lambda df: df.select("doc_id", "pos", "depth", "kind", *[(F.col(c) if c in df.columns else null(k)).cast(k).alias(c) for c, k in empty.items()])
    leaves = b.where("kind IN ('heading', 'paragraph', 'math')").select("doc_id", at("pos").alias("pos"), F.lit(0).alias("depth"), "kind", F.when(F.col("kind") == "heading", F.substring("stands", 8, 1).cast("int")).alias("level"), F.when(F.col("kind") == "math", plain).alias("text"), F.when(F.col("kind") != "math", F.col("inlines")).alias("inlines"))
    code = b.where("kind = 'code'").groupBy("doc_id", "home").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", plain.alias("s")))), lambda x: x["s"]), "\n").alias("text")).select("doc_id", at("home").alias("pos"), F.lit(0).alias("depth"), F.lit("code").alias("kind"), "text")
    quotes = b.where("kind = 'quote'")
    out = [full(leaves), full(code), full(quotes.where("pos = home").select("doc_id", at("pos").alias("pos"), F.lit(0).alias("depth"), F.lit("blockquote").alias("kind"))), full(quotes.select("doc_id", at("pos", 1).alias("pos"), F.lit(1).alias("depth"), F.lit("paragraph").alias("kind"), at("home").alias("parent"), "inlines"))]
    # lists: a paragraph opens lists down to its level; an item of a level belongs to the list opened last there
    items = b.where("kind = 'item'").select("doc_id", "pos", "home", F.least("level", F.lit(8)).alias("level"), "ordered", "inlines")
    within = Window.partitionBy("doc_id", "home").orderBy("pos")
    last = F.lag("level", 1, -1).over(within)
    items = items.withColumn("last", last)
    opens = items.where("level > last").select("doc_id", "pos", "home", "ordered", F.col("level").alias("to"), F.explode(F.sequence(F.col("last") + 1, F.col("level"))).alias("level"))
    rows = opens.select("doc_id", "home", "level", "ordered", F.lit("list").alias("kind"), at("pos").alias("base")).unionByName(opens.where("level < to").select("doc_id", "home", "level", "ordered", F.lit("item").alias("kind"), at("pos").alias("base"))).unionByName(items.select("doc_id", "home", "level", "ordered", F.lit("item").alias("kind"), at("pos").alias("base")))
    rows = rows.withColumn("pos", F.col("base") + F.col("level") * 2 + F.when(F.col("kind") == "item", 1).otherwise(0))
    # a list lies in the last item one level up, an item in the last list of its level
    own = Window.partitionBy("doc_id", "home", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    keys = F.when(F.col("kind") == "list", F.array(F.struct((F.col("level") * 2).alias("key"), F.lit(True).alias("marks")), F.struct((F.col("level") * 2 - 1).alias("key"), F.lit(False).alias("marks")))).otherwise(F.array(F.struct((F.col("level") * 2).alias("key"), F.lit(False).alias("marks")), F.struct((F.col("level") * 2 + 1).alias("key"), F.lit(True).alias("marks"))))
    placed = rows.select("*", F.inline(keys)).withColumn("parent", F.last(F.when(F.col("marks"), F.col("pos")), True).over(own)).where("NOT marks")
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("pos")) - 1
    placed = placed.withColumn("index", F.when(F.col("kind") == "item", place))
    out += [full(placed.select("doc_id", "pos", (F.col("level") * 2 + F.when(F.col("kind") == "item", 1).otherwise(0)).alias("depth"), "kind", "parent", "ordered", "index")), full(items.select("doc_id", at("pos", PLACE - 1).alias("pos"), (F.col("level") * 2 + 2).alias("depth"), F.lit("paragraph").alias("kind"), (at("pos") + F.col("level") * 2 + 1).alias("parent"), "inlines"))]
    # tables: cells with the inlines of their paragraphs, a break between them; what is merged downwards is one cell
    filled = paras.where("table IS NOT NULL").groupBy("doc_id", "table", "row", "col").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "inlines"))), lambda x: x["inlines"]).alias("ps"))
    joined_ps = F.flatten(F.transform(F.filter("ps", lambda p: F.size(p) > 0), lambda p, i: F.concat(F.when(i > 0, F.array(event(F.lit("hard_break"), F.lit("\n")))).otherwise(F.slice(p, 1, 0)), p)))
    cells = of("cell").select("doc_id", "table", "row", "col", F.col("span").alias("colspan"), F.col("text").alias("vmerge")).join(filled, ["doc_id", "table", "row", "col"], "left").withColumn("inlines", F.coalesce(joined_ps, F.array().cast(empty["inlines"]))).drop("ps")
    key = F.struct("doc_id", "table")
    merged = merged_cells(cells.select(key.alias("doc_id"), "row", "col", F.struct("inlines", "colspan").alias("text"), "vmerge")).select("doc_id.*", "row", "col", "text.*", "rowspan")
    cell = F.struct(F.when(F.col("row") == 0, "thead").otherwise("tbody").alias("section"), F.greatest(F.col("row") - 1, F.lit(0)).alias("row"), "col", plain.alias("text"), "colspan", "rowspan", null("string").alias("align"), "inlines")
    made = merged.groupBy("doc_id", "table").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    out.append(full(made.join(of("table").where("id IS NULL").select("doc_id", F.col("pos").alias("table")), ["doc_id", "table"]).select("doc_id", at("table").alias("pos"), F.lit(0).alias("depth"), F.lit("table").alias("kind"), "cells")))
    # notes, and packages that could not be read
    notes = paras.where("note IS NOT NULL AND table IS NULL")
    homes = notes.groupBy("doc_id", "note").agg(F.min("pos").alias("home"))
    out += [full(homes.select("doc_id", (F.lit(NOTES) + at("home")).alias("pos"), F.lit(0).alias("depth"), F.lit("footnote").alias("kind"), F.col("note").alias("ident"))), full(notes.join(homes, ["doc_id", "note"]).where(F.size("inlines") > 0).select("doc_id", (F.lit(NOTES) + at("pos", 1)).alias("pos"), F.lit(1).alias("depth"), F.lit("paragraph").alias("kind"), (F.lit(NOTES) + at("home")).alias("parent"), "inlines"))]
    out.append(full(of("error").select("doc_id", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("depth"), F.lit("error").alias("kind"), "text")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return tables.keep(whole)
