"""Benchmark decontamination by a generalised suffix automaton of the test items."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import Written, alnum_words, bounded_batches, in_order, running_total, task, text_bytes

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """All word sequences of a set of items; states know which items hold their windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: dict[int, set[str]] = {}
        self.shorts: dict[int, list[tuple[int, str]]] = {}
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in alnum_words(text)]) for item, text in items]
        coded = [(item, words) for item, words in coded if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.least = min([min(window, len(words)) for _, words in coded], default=window)
        #: For each state, the state of its suffix of `window` words, or -1.
        self.at_window = [self._suffix(s, window) for s in range(len(self.next))]
        for item, words in coded:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i >= window - 1 and self.at_window[state] >= 0:
                    self.owners.setdefault(self.at_window[state], set()).add(item)
            if len(words) < window:
                self.shorts.setdefault(self._suffix(state, len(words)), []).append((len(words), item))
        #: Short items at each state or at one of its suffixes.
        self.short_at = {}
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__) if self.shorts else ():
            if found := self.shorts.get(s, []) + self.short_at.get(self.link[s], []):
                self.short_at[s] = found

    def _suffix(self, state: int, n: int) -> int:
        if self.length[state] < n:
            return -1
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        new = None if known is not None else self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and new is not None and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        if new is not None:
            self.link[new] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy if new is None else new

    def prepared(self):
        """Numbers of the pairs of words that follow each other in an item, sorted."""
        import numpy as np

        into: dict[int, set[int]] = {}
        for after in self.next:
            for w, t in after.items():
                into.setdefault(t, set()).add(w)
        pairs = {(w, v) for t, before in into.items() for w in before for v in self.next[t]}
        return np.array(sorted(w * len(self.vocabulary) + v for w, v in pairs), np.int64)

    def matches(self, words: list[bytes], pairs) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans of words in windows (merged), the items whose windows occur, the longest match.

        Only runs of words that follow each other in some item can hold a window, so the automaton reads
        those runs and skips the rest.
        """
        import numpy as np

        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if self.least > 1:
            follows = np.zeros(len(ids) + 1, bool)
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            if len(both) and len(pairs):
                code = ids[both] * len(self.vocabulary) + ids[both + 1]
                at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
                follows[both[pairs[at] == code] + 1] = True
            starts = np.flatnonzero(~follows[:-1])
            ends = np.append(starts[1:], len(ids))
            long = ends - starts >= self.least
            runs = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        else:
            runs = [(0, len(ids))]
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        for begin, end in runs:
            state = length = 0
            for i, w in enumerate(ids[begin:end].tolist(), begin):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w not in self.next[state]:
                    continue
                state = self.next[state][w]
                length += 1
                longest = max(longest, length)
                hit = 0
                if length >= self.window:
                    items |= self.owners[self._suffix(state, self.window)]
                    hit = self.window
                for n, item in self.short_at.get(state, ()):
                    if length >= n:
                        items.add(item)
                        hit = max(hit, n)
                if hit:
                    first = i + 1 - hit
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return spans, items, longest


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items (item_id, text) in blocks of about block_bytes of text; one block is on the driver at a time."""
    written = Written(items.sparkSession, "items")
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("_size"))
    placed = running_total(in_order(sized, [F.col("item_id"), F.col("text")], written, "sorted"), "_size", "_upto")
    blocked = written.table(placed.select("item_id", "text", F.expr(f"(_upto - _size) div {block_bytes}").alias("_block")), "blocks")
    for block in sorted(r[0] for r in blocked.select("_block").distinct().collect()):
        rows = blocked.where(F.col("_block") == block).collect()
        yield [(r["item_id"] or "", (r["text"] or "").encode()) for r in rows]
    written.drop("sorted", "blocks")


FOUND = "struct<n_words:long,spans:array<struct<first:long,end:long>>,items:array<string>,longest:long>"


def find_leaks(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", block_bytes: int = 1 << 20) -> DataFrame:
    """Adds `_leaks` to docs: n_words, merged spans of hit words, sorted ids of items, longest match in words.

    A window is `window` consecutive words of an item, or all of an item that has fewer. Each block of
    items becomes a suffix automaton, of bounded size, that every task streams its documents through;
    with several blocks each pass is written before the next, so one automaton is in memory at a time, and
    their spans are merged. Null texts and items have no words; a null item id counts as the empty string,
    repeated ids as one; repeated rows are judged each; a very long text is streamed whole in one task; an
    empty table of documents gives no rows, one of items no hits. A column `_leaks` is replaced, all others
    stay whatever their names.
    """
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    kept = [c for c in docs.columns if c != "_leaks"]
    inner = [f"_c{i}" for i in range(len(kept))]
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, inner, strict=True)]).withColumn("_leaks", F.lit(None).cast(FOUND))
    at = kept.index(text)
    schema = out.schema
    written, shared = Written(docs.sparkSession, "leaks"), None
    for n, block in enumerate(item_blocks(items, block_bytes)):
        if shared is not None:
            out = written.table(out, f"pass-{n}")
            shared.unpersist()
            written.drop(f"pass-{n - 1}")
        automaton = SuffixAutomaton(block, window)
        shared = sc.broadcast((automaton, automaton.prepared()))
        out = out.mapInArrow(task(_leak_pass(shared, at)), schema)
    empty = F.struct(F.lit(None).cast("long").alias("n_words"), F.array().cast("array<struct<first:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest"))
    named = out.withColumn("_leaks", F.coalesce("_leaks", empty))
    return named.withColumnsRenamed(dict(zip(inner, kept, strict=True)))


def _leak_pass(shared, at: int):
    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        automaton, pairs = shared.value
        for batch in batches:
            rows = []
            for raw, before in zip(text_bytes(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                words = alnum_words(raw)
                spans, items, longest = automaton.matches(words, pairs)
                if before:
                    spans = merged([*spans, *((s["first"], s["end"]) for s in before["spans"])])
                    items |= set(before["items"])
                    longest = max(longest, before["longest"])
                rows.append({"n_words": len(words), "spans": [{"first": a, "end": b} for a, b in spans], "items": sorted(items), "longest": longest})
            found = pa.array(rows, type=batch.schema.field(batch.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], schema=batch.schema)

    return scan


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str | None, spans: list) -> str | None:
    """The text without the words of the spans (first, end) and what stands between them."""
    if not spans or text is None:
        return text
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for first, end in spans:
        out.append(raw[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()


@F.pandas_udf(T.StringType())
def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_words(t, [(s["first"], s["end"]) for s in x]) for t, x in zip(texts, spans, strict=True)], dtype=object)


def remove_leaks(docs: DataFrame, items: DataFrame, window: int = 10, most_covered: float = 0.5, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """`docs` without leaked passages: hit spans are cut out of the text, and a row of which they cover more
    than `most_covered` goes altogether. Rows without a hit stay as they are, null texts too; columns stay the
    same, whatever their names; repeated rows are cut alike. Where text was cut, the column `length`, if there is one, gets its new number of characters."""
    inner = {c: f"_d{i}" for i, c in enumerate(docs.columns)}
    leaks = find_leaks(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), items, window, inner[text])
    hit = F.aggregate("_leaks.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    left = leaks.where((hit == 0) | (hit <= most_covered * F.col("_leaks.n_words")))
    own = F.col(inner[text])
    done = left.withColumn(inner[text], F.when(hit > 0, cut(own, F.col("_leaks.spans"))).otherwise(own))
    if length in inner:
        done = done.withColumn(inner[length], F.when(hit > 0, F.length(own)).otherwise(F.col(inner[length])).cast(docs.schema[length].dataType))
    return done.select(*[F.col(n).alias(c) for c, n in inner.items()])


def op6_suffix_automaton(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("_leaks.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return leaks.select(
        "doc_id", F.coalesce("_leaks.n_words", F.lit(0).cast("long")).alias("n_words"), hit.alias("n_hit"), F.size("_leaks.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_leaks.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM iw WHERE len(w) > 0)
), ns AS (
  SELECT DISTINCT n FROM win
), dwin AS (
  SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM dw, ns WHERE len(w) >= n)
), hits AS (
  SELECT r, i, n, item FROM dwin JOIN win USING (n, s)
), pos AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
