"""Numbers, ids, nesting and labels of a document's blocks, as windows over document order.

All functions take `blocks` with doc_id and pos (document order, unique in a document). Windows are by
doc_id alone, so one shuffle serves a chain of them. Numbering and the like first keep the headings or
labelled blocks, which are few; `containers` leaves out blocks inside tables and definition lists, which
the traversals do not enter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
#: Printed names of what can be referred to.
KIND_NAMES = {"figure": "Figure", "table": "Table", "equation": "Equation", "section": "Section", "code": "Listing"}
#: Containers that numbering and the table of contents look into.
ENTERED = ["blockquote", "list", "admonition", "div", "footnote"]


def so_far():
    return Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def containers(blocks: DataFrame) -> DataFrame:
    """Blocks all of whose `ancestors` are entered by the traversals."""
    return blocks.where(F.forall("ancestors", lambda a: a.isin(*ENTERED))) if "ancestors" in blocks.columns else blocks


def number_sections(headings: DataFrame, top: str | None = None) -> DataFrame:
    """Adds number, like 1.2.3, to headings (doc_id, pos, level); a level that was skipped counts 0.

    The counter of level k is the number of its headings less those before the last heading above it.
    With `top` (Chapter or Part), level 1 has that name before its number.
    """
    count = {k: F.sum((F.col("level") == k).cast("long")).over(so_far()) for k in range(1, LEVELS + 1)}
    h = headings.withColumns({f"_c{k}": count[k] for k in count})
    h = h.withColumns({f"_b{k}": F.max(F.when(F.col("level") < k, F.col(f"_c{k}"))).over(so_far()) for k in count})
    parts = F.array(*[(F.col(f"_c{k}") - F.coalesce(f"_b{k}", F.lit(0))).cast("string") for k in count])
    number = F.array_join(F.slice(parts, F.lit(1), F.col("level")), ".")
    if top:
        number = F.when(F.col("level") == 1, F.concat(F.lit(f"{top} "), number)).otherwise(number)
    return h.withColumn("number", number).drop(*[f"_{x}{k}" for x in "cb" for k in count])


def number_labels(blocks: DataFrame) -> DataFrame:
    """Adds number to blocks (doc_id, pos, kind, ident): counted by kind, headings as sections, where they have an ident."""
    kind = F.when(F.col("kind") == "heading", "section").otherwise(F.col("kind"))
    labelled = blocks.where(F.col("ident").isNotNull() & kind.isin(*KIND_NAMES)).withColumn("label_kind", kind)
    number = F.sum(F.lit(1)).over(Window.partitionBy("doc_id", "label_kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return labelled.withColumn("number", number)


def label_index(numbered: DataFrame) -> DataFrame:
    """One row for each label of a document; of repeated labels the last counts."""
    last = F.max_by(F.struct("label_kind", "number"), "pos").alias("l")
    return numbered.groupBy("doc_id", F.col("ident").alias("label")).agg(last).select("doc_id", "label", "l.label_kind", "l.number")


def reference_text(form: Column, custom: Column, kind: Column, number: Column) -> Column:
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KIND_NAMES.items() for x in kv]), kind), F.lit("Item"))
    n = number.cast("string")
    return F.when(form == "number_with_type", F.concat_ws(" ", name, n)).when(form == "custom", F.concat_ws(" ", custom, n)).otherwise(n)


def resolve_crossrefs(refs: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds text to refs (doc_id, target, form, custom_text): null where the document has no such label."""
    known = labels.withColumnRenamed("label", "target")
    joined = refs.join(known, ["doc_id", "target"], "left")
    text = F.when(F.col("number").isNotNull(), reference_text(F.col("form"), F.col("custom_text"), F.col("label_kind"), F.col("number")))
    return joined.withColumn("text", text).drop("label_kind", "number")


def unresolved(refs: DataFrame, labels: DataFrame) -> DataFrame:
    return refs.join(labels.withColumnRenamed("label", "target"), ["doc_id", "target"], "left_anti")


def section_tree(headings: DataFrame) -> DataFrame:
    """Adds parent (pos of the nearest heading above with a lower level) and until (pos of the next of no higher level).

    For each level one running maximum of positions from above and one minimum from below.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    up = {f"_u{k}": F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in range(1, LEVELS + 1)}
    down = {f"_d{k}": F.min(F.when(F.col("level") == k, F.col("pos"))).over(after) for k in range(1, LEVELS + 1)}
    h = headings.withColumns(up | down)
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"_u{k}")) for k in range(1, LEVELS + 1)])
    until = F.least(*[F.when(F.col("level") >= k, F.col(f"_d{k}")) for k in range(1, LEVELS + 1)])
    return h.withColumns({"parent": parent, "until": until}).drop(*up, *down)


def section_membership(blocks: DataFrame) -> DataFrame:
    """Adds section to each block: the pos of the heading it stands under, its own for a heading, null before the first."""
    return blocks.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("pos")), ignorenulls=True).over(so_far()))


def dedup_ids(headings: DataFrame) -> DataFrame:
    """Adds id to headings (doc_id, pos, slug): a slug seen before gets -1, -2, ... , the first that is free.

    Numbers by a window are right unless one of them is a slug itself; documents in which that happens are
    done again, heading by heading, with the ids seen so far.
    """
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("pos")) - 1
    id_ = F.when(n == 0, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string")))
    guessed = headings.withColumn("id", id_)
    taken = guessed.where("id != slug").select("doc_id", "id").join(headings.select("doc_id", F.col("slug").alias("id")), ["doc_id", "id"], "left_semi").select("doc_id").distinct()
    start = F.struct(F.array().cast("array<string>").alias("seen"))

    def candidate(slug: Column, k: Column) -> Column:
        return F.when(k == 0, slug).otherwise(F.concat_ws("-", slug, k.cast("string")))

    def add(state: Column, h: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(state["seen"])), lambda k: ~F.array_contains(state["seen"], candidate(h["slug"], k)))
        return F.struct(F.concat(state["seen"], F.array(candidate(h["slug"], F.element_at(free, 1)))).alias("seen"))

    folded = headings.join(taken, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "slug"))).alias("hs"))
    folded = folded.withColumn("ids", F.aggregate("hs", start, add, lambda s: s["seen"]))
    pairs = folded.select("doc_id", F.inline(F.arrays_zip(F.transform("hs", lambda h: h["pos"]).alias("pos"), F.col("ids").alias("exact"))))
    return guessed.join(pairs, ["doc_id", "pos"], "left").withColumn("id", F.coalesce("exact", "id")).drop("exact")


def toc_tree(headings: DataFrame, depth: int = 3) -> DataFrame:
    """Entries of tables of contents from headings (doc_id, pos, level, id, text): doc_id, pos, nesting, parent, url.

    Headings without id or deeper than `depth` are left out. A list takes the level of its first entry. An
    entry between the levels of a list and of the one in it ends the inner list and is left out with what
    follows, up to the next entry of the outer list; one above the first level ends the table.
    """
    entries = headings.where(F.col("id").isNotNull() & (F.col("level") <= depth))
    lists = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "id"))).alias("hs"))
    node = "array<struct<level:int,pos:bigint>>"
    out = "array<struct<pos:bigint,nesting:int,parent:bigint,url:string>>"
    start = F.struct(F.array().cast(node).alias("open"), F.lit(False).alias("dead"), F.array().cast(out).alias("out"))

    def add(s: Column, h: Column) -> Column:
        level, pos = h["level"].cast("int"), h["pos"].cast("bigint")
        kept = F.filter(s["open"], lambda o: o["level"] <= level)
        first = F.size(s["open"]) == 0
        over = ~first & (F.size(kept) == 0)  # above the first level
        last = F.try_element_at(kept, F.lit(-1))
        popped = F.size(kept) < F.size(s["open"])
        sibling = ~first & ~over & (last["level"] == level)
        lost = over | (~first & ~sibling & (popped | s["dead"]))
        base = F.when(sibling, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)
        opened = F.concat(base, F.array(F.struct(level.alias("level"), pos.alias("pos"))))
        entry = F.struct(pos.alias("pos"), F.size(base).alias("nesting"), F.try_element_at(base, F.lit(-1))["pos"].alias("parent"), F.concat(F.lit("#"), h["id"]).alias("url"))
        never = F.array(F.struct(F.lit(0).alias("level"), F.lit(-1).cast("bigint").alias("pos"))).cast(node)
        return F.struct(
            F.when(over, never).when(lost, kept).otherwise(opened).alias("open"),
            lost.alias("dead"),
            F.when(lost, s["out"]).otherwise(F.concat(s["out"], F.array(entry))).cast(out).alias("out"),
        )

    return lists.select("doc_id", F.inline(F.aggregate("hs", start, add, lambda s: s["out"])))


def table_captions(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, pos, kind, text) with `caption` on tables, from a paragraph `Table: ...` or `: ...` next to them.

    The paragraph above counts first, one below only for a table without it; paragraphs used are removed. A
    paragraph between two tables goes to the one below it.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    said = F.coalesce(F.nullif(F.regexp_extract("text", r"(?s)^Table:\s*(\S.*)$", 1), F.lit("")), F.nullif(F.regexp_extract("text", r"(?s)^: (.*)$", 1), F.lit("")))
    b = blocks.withColumn("_said", F.when(F.col("kind") == "paragraph", said))
    b = b.withColumns({"_prev": F.lag("kind").over(w), "_next": F.lead("kind").over(w), "_above": F.lag("_said").over(w), "_below": F.lead("_said").over(w)})
    b = b.withColumn("_served", F.lead(F.col("kind") == "table", 2).over(w))  # what follows the paragraph below is a table
    table = F.col("kind") == "table"
    caption = F.when(table, F.coalesce("_above", F.when(~F.coalesce("_served", F.lit(False)), F.col("_below"))))
    b = b.withColumn("caption", caption).withColumn("_took", F.lag(table & F.col("_above").isNotNull()).over(w))
    used = F.col("_said").isNotNull() & ((F.col("_next") == "table") | ((F.col("_prev") == "table") & ~F.coalesce("_took", F.lit(False))))
    return b.where(~F.coalesce(used, F.lit(False))).drop("_said", "_prev", "_next", "_above", "_below", "_served", "_took")


def footnote_counter(notes: DataFrame) -> DataFrame:
    """Adds id fn1, fn2, ... to footnotes (doc_id, pos) that have none, in document order."""
    numbered = F.sum(F.col("id").isNull().cast("long")).over(so_far())
    return notes.withColumn("id", F.coalesce("id", F.concat(F.lit("fn"), numbered)))


def footnote_join(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References (doc_id, id) with the text of their note; the last top-level definition of an id counts."""
    last = defs.where("depth = 0").groupBy("doc_id", "id").agg(F.max_by("text", "pos").alias("note"))
    return refs.join(last, ["doc_id", "id"], "left")


def note_numbers(defs: DataFrame) -> DataFrame:
    """Adds number to top-level footnote definitions: from 2 on, in document order."""
    return defs.where("depth = 0").withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) + 1)


def code_lines(blocks: DataFrame) -> DataFrame:
    """Lines of code blocks (doc_id, pos, text, start, ranges): line, number from start on, and whether a range has the line."""
    lines = blocks.select("doc_id", "pos", "start", "ranges", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hit = F.exists("ranges", lambda r: (r["lo"] <= F.col("i") + 1) & (F.col("i") + 1 <= r["hi"]))
    return lines.select("doc_id", "pos", (F.col("i") + 1).alias("line_no"), (F.col("start") + F.col("i")).alias("number"), "line", hit.alias("highlighted"))
