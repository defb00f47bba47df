"""A Merkle manifest of a table: a tree of digests for each group, a root over all groups, and a proof for each row.

Rows of a group get their rank in it. The digits of a rank are columns; one after the other is grouped away, from the
last to the first, and the structs of the children nest in that of their parent. This happens inside blocks of a
bounded number of rows, all of them dealt out once. The roots of blocks are the leaves of the next tier, which is
built the same way, until each group has one root; those are the leaves of the tree over the groups. Proofs come from
walking down: a transform hands to each child what stands beside it, an explode goes one level down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Written, in_order, small

#: Children of a node; digits of a rank that are grouped away inside one block, so that a block has ARITY ** DIGITS leaves.
ARITY, DIGITS = 2, 8
#: A table of no more rows is broadcast.
SMALL = 200_000


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: each value with its length in bytes before it, `-` for null."""
    return F.sha2(F.concat(*map(_field, columns)), 256)


def ranked(rows: DataFrame, group: str, order: list[str], written: Written, name: str) -> DataFrame:
    """rows with `rank` (from 0) and `m` (number of rows) in their group, by one global order; nulls are a group of their own."""
    placed = in_order(rows, [F.col(c).asc_nulls_first() for c in (group, *order)], written, name)
    parts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    of_group = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), before.alias("_before"), F.sum("_n").over(of_group).alias("m"))
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy("_at"))
    met = placed.withColumn("rank", own - 1).join(small(parts, SMALL), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return met.withColumn("rank", F.col("rank") + F.col("_before")).drop("_g", "_p", "_before", "_at", "_part")


def rolled_up(leaves: DataFrame, arity: int, digits: int) -> DataFrame:
    """leaves (tree, rank, m, node) to (tree, block, m, node): one nested node for each block of arity ** digits ranks.

    A node is a struct with its digest `h`; an inner one has `level` and its `kids` in order. A level at which the
    tree has but one node adds nothing.
    """
    digit = [F.expr(f"int(rank div {arity**i} % {arity})").alias(f"d{i}") for i in range(digits)]
    rows = leaves.select("tree", F.expr(f"rank div {arity**digits}").alias("block"), *digit, "m", "node").repartition("tree", "block")
    for i in range(digits):
        keys = ["tree", "block", *(f"d{j}" for j in range(i + 1, digits))]
        kids = F.array_sort(F.collect_list(F.struct(F.col(f"d{i}").alias("digit"), "node"))).alias("kids")
        rows = rows.groupBy(*keys).agg(kids, F.max("m").alias("m"))
        joined = F.sha2(F.concat_ws("", F.col("kids.node.h")), 256)
        h = F.when(F.col("m") > 1, joined).otherwise(F.col("kids")[0]["node"]["h"])
        node = F.struct(h.alias("h"), (F.col("m") > 1).alias("level"), F.col("kids.node").alias("kids"))
        rows = rows.select(*keys, F.ceil(F.col("m") / arity).alias("m"), node.alias("node"))
    return rows


def walked_down(rows: DataFrame, digits: int) -> DataFrame:
    """Rows (.., node, path) of blocks to their leaves: `path` gets the digests before and after each node, from the leaf up."""
    for _ in range(digits):
        kids = F.col("node.kids")
        beside = lambda i: F.struct(
            F.concat_ws("", F.slice(kids["h"], F.lit(1), i)).alias("before"),
            F.concat_ws("", F.slice(kids["h"], i + 2, F.lit(1 << 20))).alias("after"),
        )
        path = lambda i: F.when(F.col("node.level"), F.concat(F.array(beside(i)), F.col("path"))).otherwise(F.col("path"))
        step = F.transform(kids, lambda kid, i: F.struct(kid.alias("node"), path(i).alias("path"), i.alias("digit")))
        rows = rows.withColumn("kid", F.explode(step)).withColumns({"node": F.col("kid.node"), "path": F.col("kid.path")}).drop("kid")
    return rows


PATH = "array<struct<before: string, after: string>>"


def proven(leaves: DataFrame, written: Written, name: str, arity: int = ARITY, digits: int = DIGITS) -> tuple[DataFrame, DataFrame]:
    """leaves (tree, rank, m, node, with digest node.h) to (roots, nodes): roots (tree, h), and (tree, node, path) for each leaf.

    The tier above is a table of one row for each block; what it proves of a block comes to that block in a
    group by (tree, block), not in a join.
    """
    blocks = written.table(rolled_up(leaves, arity, digits), f"{name}-blocks")
    if blocks.where("block > 0").isEmpty():
        roots = blocks.select("tree", "node.h")
        return roots, walked_down(blocks.select("tree", "node", F.array().cast(PATH).alias("path")), digits).select("tree", "node", "path")
    upper = blocks.select("tree", F.col("block").alias("rank"), "m", F.struct("node.h", F.col("block").alias("block")).alias("node"))
    roots, above = proven(upper, written, f"{name}-up", arity, digits)
    above = above.select("tree", F.col("node.block").alias("block"), "path")
    both = blocks.select("tree", "block", "node").unionByName(above, allowMissingColumns=True)
    met = both.groupBy("tree", "block").agg(F.first("node", True).alias("node"), F.first("path", True).alias("path"))
    return roots, walked_down(met, digits).select("tree", "node", "path")


def manifest(rows: DataFrame, group: str, order: str, columns: list[str], tampered: dict[str, Column] | None = None, arity: int = ARITY, digits: int = DIGITS) -> DataFrame:
    """`order`, `group`, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    A leaf is the SHA-256 of the row's `columns`. Leaves of a group ascend by `order` (then by digest, so that rows
    alike in it have a defined place); runs of `arity` nodes become their common digest until one is left. The roots of
    groups, in the order of the group's value, become the root of the table in the same way. A proof is what stands
    beside a row's nodes, from the leaf up; `folded_root` folds the row's digest with it. `tampered` replaces columns
    (by expressions over the row) before the row is folded, so that tests can show that a changed row is found.

    Null in any column is a value of its own, also as group (first in order) or order (first in its group). Empty and
    very long texts are hashed whole. Repeated rows are leaves of their own. An empty table gives no rows. Other
    columns, of whatever name, are not looked at. Only digests and keys are moved, once for each order and block;
    a block has at most arity ** digits rows, whatever the size of its group.
    """
    written = Written(rows.sparkSession, "merkle")
    changed = {c: F.col(c) for c in columns} | (tampered or {})
    leaf, folded = leaf_digest([F.col(c) for c in columns]), leaf_digest([changed[c] for c in columns])
    hashed = written.table(rows.select(F.col(group).alias("tree"), F.col(order).alias("key"), leaf.alias("h"), folded.alias("t")), "leaves")
    leaves = ranked(hashed, "tree", ["key", "h"], written, "order").withColumn("node", F.struct("h", "t", "key"))
    subroots, nodes = proven(leaves.select("tree", "rank", "m", "node"), written, "group", arity, digits)
    tops = ranked(subroots.select(F.lit(0).alias("all"), "tree", "h"), "all", ["tree"], written, "groups")
    tops = tops.select(F.col("all").alias("tree"), "rank", "m", F.struct("h", F.col("tree").alias("name")).alias("node"))
    root, above = proven(tops, written, "all", arity, digits)
    above = above.join(F.broadcast(root.select("tree", F.col("h").alias("root"))), "tree")  # root is one row
    above = above.select(F.col("node.name").alias("name"), F.col("node.h").alias("subroot"), F.col("path").alias("over"), "root")
    found = nodes.join(small(written.table(above, "above"), SMALL), F.col("tree").eqNullSafe(F.col("name")))
    path = F.concat("path", "over")
    fold = F.aggregate(path, F.col("node.t"), lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))
    proof = F.sha2(F.concat_ws("", F.transform(path, lambda x: F.concat(x["before"], x["after"]))), 256)
    out = found.select(F.col("node.key").alias(order), F.col("tree").alias(group), F.col("node.h").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))
    changed = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest(docs, "lang", "doc_id", ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": changed})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                                     lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) % 7 = 0 AS hit
  FROM documents, crc
), f AS (
  SELECT r, doc_id, lang, hit, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS z
  FROM d
), x AS (
  SELECT r, doc_id, lang, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
         sha256(a || coalesce(strlen(CAST(n_chars + CASE WHEN hit THEN 1 ELSE 0 END AS VARCHAR)) || ':' || (n_chars + CASE WHEN hit THEN 1 ELSE 0 END), '-') || z) AS told
  FROM f
), l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS m FROM x
), t(lang, lvl, k, m, h) AS (
  SELECT lang, 0, k, m, leaf FROM l
  UNION ALL
  SELECT lang, lvl + 1, k // 2, any_value((m + 1) // 2), sha256(string_agg(h, '' ORDER BY k)) FROM t WHERE m > 1 GROUP BY lang, lvl, k // 2
), g AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) OVER () AS m FROM t WHERE m = 1
), u(lvl, k, m, h) AS (
  SELECT 0, k, m, h FROM g
  UNION ALL
  SELECT lvl + 1, k // 2, any_value((m + 1) // 2), sha256(string_agg(h, '' ORDER BY k)) FROM u WHERE m > 1 GROUP BY lvl, k // 2
), w(r, lang, lvl, k, m, proof, fold) AS (
  SELECT r, lang, 0, k, m, '', told FROM l
  UNION ALL
  SELECT w.r, w.lang, w.lvl + 1, w.k // 2, (w.m + 1) // 2, w.proof || coalesce(t.h, ''), sha256(CASE WHEN w.k % 2 = 0 THEN w.fold || coalesce(t.h, '') ELSE t.h || w.fold END)
  FROM w LEFT JOIN t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lvl = w.lvl AND t.k = xor(w.k, 1) WHERE w.m > 1
), v(r, lvl, k, m, proof, fold) AS (
  SELECT w.r, 0, g.k, g.m, w.proof, w.fold FROM w JOIN g ON g.lang IS NOT DISTINCT FROM w.lang WHERE w.m = 1
  UNION ALL
  SELECT v.r, v.lvl + 1, v.k // 2, (v.m + 1) // 2, v.proof || coalesce(u.h, ''), sha256(CASE WHEN v.k % 2 = 0 THEN v.fold || coalesce(u.h, '') ELSE u.h || v.fold END)
  FROM v LEFT JOIN u ON u.lvl = v.lvl AND u.k = xor(v.k, 1) WHERE v.m > 1
)
SELECT l.doc_id, l.leaf, g.h AS subroot, u.h AS root, sha256(v.proof) AS proof_sha256, v.fold AS folded_root, v.fold = u.h AS verified
FROM l JOIN g ON g.lang IS NOT DISTINCT FROM l.lang JOIN v ON v.r = l.r AND v.m = 1 JOIN u ON u.m = 1
"""
