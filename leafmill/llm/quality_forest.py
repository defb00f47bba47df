"""Quality rules: an isolation forest on rule statistics, with a threshold from labelled rows that pass the base rules."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Written, bounded_batches, task, text_bytes

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: Bytes that begin no code point.
INNER = bytes(range(0x80, 0xC0))
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest sees besides: letters A-Z in both cases, those in upper case, words without a letter or digit.
SHAPE = ["n_letters", "n_upper", "n_bare_words"]
MEASURES = [*STATISTICS, *SHAPE]
CAPITALS, LETTERS = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))
#: Anomaly scores are multiples of 1 / STEPS, so that the scores of any number of rows can be counted in a table of fixed size.
STEPS = 1 << 16
#: Bytes that are no letter, digit, white space or part of a non-ASCII character.
MARKS = bytes(c for c in range(128) if c not in LETTERS + b"0123456789" + SPACES)


def rule_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text in UTF-8."""
    import numpy as np

    words = text.split()
    chars = len(text.translate(None, SPACES + INNER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        again = counts[which] > 1
        if again.any():
            hit = np.zeros(len(words), bool)
            for k in range(3):
                hit[k : len(words) - 2 + k] |= again
            repeated = int(hit.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def shape(text: bytes) -> tuple[int, int, int]:
    """n_letters, n_upper, n_bare_words of one whole text in UTF-8."""
    size = len(text)
    return size - len(text.translate(None, LETTERS)), size - len(text.translate(None, CAPITALS)), len(text.split()) - len(text.translate(None, MARKS).split())


def measures(texts: list[bytes]):
    """An array of the MEASURES of each text."""
    import numpy as np

    return np.array([rule_statistics(t) + shape(t) for t in texts], np.int64).reshape(-1, len(MEASURES))


def features(stats):
    """The forest's features from an array of measures: length, word length, shares of the words, and capitals among the letters."""
    import numpy as np

    n, letters = np.maximum(stats[:, 0], 1.0), np.maximum(stats[:, 5], 1.0)
    return np.column_stack([np.log1p(stats[:, 0]), stats[:, 1] / n, stats[:, 2] / n, stats[:, 3] / n, stats[:, 4] / n, stats[:, 6] / letters, stats[:, 7] / n])


def base_failures(stats):
    """Which rows of an array of measures fail the base rules: too few words, or too many that repeat."""
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


class IsolationForest:
    """Trees of random splits on `size` rows each; anomalies have short paths from the root.

    Each tree draws its rows from `rows`, or grows on its part of `drawn`, one array for each tree.
    """

    def __init__(self, rows, trees: int, size: int, seed: int, drawn: list | None = None):
        import numpy as np

        most = len(rows) if drawn is None else max(map(len, drawn), default=0)
        rng, self.size = np.random.default_rng(seed), max(2, min(size, most))
        self.depth = int(np.ceil(np.log2(self.size)))
        width = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, width), -1, np.int64)
        self.split = np.zeros((trees, width))
        self.path = np.zeros((trees, width))
        for t in range(trees if most else 0):
            todo = [(0, 0, rows[rng.choice(len(rows), self.size, replace=len(rows) < self.size)] if drawn is None else drawn[t])]
            while todo:
                node, depth, part = todo.pop()
                spread = part.max(0) - part.min(0)
                usable = np.flatnonzero(spread > 0)
                if depth == self.depth or len(part) <= 1 or not len(usable):
                    self.path[t, node] = depth + self.usual(len(part))
                    continue
                f = int(rng.choice(usable))
                at = part[:, f].min() + rng.random() * spread[f]
                self.feature[t, node], self.split[t, node] = f, at
                low = part[:, f] <= at
                todo += [(2 * node + 1, depth + 1, part[low]), (2 * node + 2, depth + 1, part[~low])]

    @staticmethod
    def usual(n: int) -> float:
        """Mean path length of an unsuccessful search in a binary tree of n rows."""
        import numpy as np

        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def scores(self, rows):
        """Anomaly scores in 0 .. 1, in steps of 1 / STEPS; near 1 for rows that few splits set apart."""
        import numpy as np

        total, each = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                right = rows[each, np.maximum(f, 0)] > split[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return np.floor(2.0 ** (-total / len(self.path) / self.usual(self.size)) * STEPS) / STEPS


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures of each row's whole text: key and MEASURES as long. Null counts as no text."""
    kind = dict(docs.dtypes)[key]

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = measures(text_bytes(batch.column(1)))
            columns = [pa.array(found[:, i]) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *MEASURES])

    return docs.select(key, F.col(text).alias("_text")).mapInArrow(task(measure), f"`{key}` {kind}, " + ", ".join(f"{s} long" for s in MEASURES))


def threshold_of(good, bad, lost: float, n_good=None, n_bad=None) -> tuple[float, int]:
    """(threshold, caught): rows of quality 0 with scores above the threshold are caught, and no more than the share `lost` of good ones lies above.

    As many as possible are caught; of the thresholds that catch the same rows, one halfway to the next lower
    score of any row is taken. Where none can be caught only the loss counts; without good rows nothing is above.
    `n_good` and `n_bad` say how many rows have each score; one each if they are missing.
    """
    import numpy as np

    if not len(good):
        return 1.0, 0
    order = np.argsort(good)
    upto = np.cumsum(np.ones(len(good), np.int64) if n_good is None else n_good[order])
    least = float(good[order][np.searchsorted(upto, upto[-1] - 1 - int(lost * upto[-1]), side="right")])
    above = bad > least
    if not above.any():
        return least, 0
    first = bad[above].min()
    below = np.concatenate([good[good < first], bad[bad < first]]).max()
    return float((below + first) / 2), int(above.sum() if n_bad is None else n_bad[above].sum())


def drawn_rows(seen: DataFrame, n: int, trees: int, size: int, seed: int) -> list:
    """The features of `size` of the n rows of `seen` for each tree: those with the smallest hashes of row and tree, so any row may be drawn.

    Rows whose hash is above what one and a half times `size` rows of n have are left out before the hashes are ranked: that
    leaves fewer than 256 of 384 once in 10**10 draws, and then a tree has fewer rows.
    """
    import numpy as np

    share = min(1.0, 1.5 * size / max(n, 1))
    at_most = (int(share * (1 << 32)) << 31) - 1
    draw = lambda t: F.shiftrightunsigned(F.xxhash64("_row", t), 1)
    rows = seen.withColumn("_row", F.xxhash64(F.lit(seed), "doc_id", *MEASURES))
    rows = rows.select("_row", *MEASURES, F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) <= F.lit(at_most))).alias("_tree"))
    first = F.row_number().over(Window.partitionBy("_tree").orderBy(draw(F.col("_tree")), *MEASURES))
    got = rows.withColumn("_n", first).where(F.col("_n") <= size).select("_tree", "_n", *MEASURES).toArrow()
    found = np.column_stack([got.column(i).to_numpy().astype(np.int64) for i in range(got.num_columns)])
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    ends = np.searchsorted(found[:, 0], np.arange(trees + 1))
    return [features(found[a:b, 2:].astype(float)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def score_counts(seen: DataFrame, forests: list[IsolationForest]):
    """How often each score stands, of all rows that pass the base rules: an array of forest, quality, score in STEPS and count."""
    import numpy as np

    shared = seen.sparkSession.sparkContext.broadcast(forests)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            known = np.column_stack([c.to_numpy() for c in batch.columns])
            known = known[~base_failures(known)]
            seen = features(known[:, :-1].astype(float))
            for i, forest in enumerate(shared.value):
                steps = (forest.scores(seen) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), i)), pa.array(known[:, -1]), pa.array(steps)], names=["forest", "quality", "step"])

    rows = seen.select(*MEASURES, F.col("quality").cast("long").alias("quality"))
    counts = rows.mapInArrow(task(judge), "forest long, quality long, step long").groupBy("forest", "quality", "step").count().toArrow()
    return np.column_stack([counts.column(i).to_numpy().astype(np.int64) for i in range(4)])


def fit_forest(docs: DataFrame, labels: DataFrame, trees: int = 100, size: int = 256, lost: float = 0.001, seed: int = 7, tries: int = 4):
    """A forest and its threshold from all labelled rows: (forest, threshold).

    Each tree grows on `size` rows, as an isolation forest does, drawn anew from all labelled rows, so the forest
    knows what is usual. The threshold is set by all of them that pass the base rules, since it decides on no
    others: it catches the most rows of quality 0 of which no more than the share `lost` of the rows of quality 1
    is above as well. Of `tries` forests with other draws the one that catches the most is taken. Without
    labelled rows nothing is an anomaly. The measures of labelled rows are written once; the driver gets the rows of
    the trees and one count for each step of the scores, both of a size that does not grow with the tables.
    """
    bounded_batches(docs.sparkSession)
    tries, written = max(1, tries), Written(docs.sparkSession, "forest")
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    seen = written.table(statistics(docs.select("doc_id", "text")).join(chosen, "doc_id"), "seen")
    drawn = drawn_rows(seen, seen.count(), tries * trees, size, seed)
    forests = [IsolationForest(None, trees, size, seed + i, drawn[i * trees : (i + 1) * trees]) for i in range(tries)]
    counts, best = score_counts(seen, forests), None
    written.drop("seen")
    for i, forest in enumerate(forests):
        good, bad = (counts[(counts[:, 0] == i) & (counts[:, 1] == q), 2:] for q in (1, 0))
        threshold, caught = threshold_of(good[:, 0] / STEPS, bad[:, 0] / STEPS, lost, good[:, 1], bad[:, 1])
        if best is None or caught > best[0]:
            best = caught, forest, threshold
    return best[1:]


def score_quality(docs: DataFrame, forest: IsolationForest, threshold: float, keep: list[str], text: str = "text", only_kept: bool = False) -> DataFrame:
    """Adds the statistics, base_failed, anomaly and kept to the columns `keep` of each row; with `only_kept` just these columns of the rows that are kept.

    A text fails the base rules with fewer than 50 words, or if over half of its words lie in three-word
    windows that it repeats. Others are kept unless their anomaly score is above the threshold; a score equal to
    it is kept. Null and empty texts fail. Each row is judged by itself, so repeated rows get one verdict;
    a very long text is read whole in one task; an empty table gives no rows. A column of `keep` with the name
    of an added one makes room for it, and stays what it is with `only_kept`. The forest's size is fixed by its
    parameters, so it goes to every task.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    inner = [f"_k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)], *([] if text in keep else [F.col(text).alias("_text")]))
    at = keep.index(text) if text in keep else len(keep)
    kinds = dict(given.dtypes)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            stats = measures(text_bytes(batch.column(at)))
            failed = base_failures(stats)
            anomaly = shared.value.scores(features(stats.astype(float)))
            columns = [*batch.columns[: len(keep)], *[pa.array(stats[:, i]) for i in range(len(STATISTICS))], pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly <= threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=[*inner, *STATISTICS, "base_failed", "anomaly", "kept"])

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in inner), *(f"{s} long" for s in STATISTICS), "base_failed boolean, anomaly double, kept boolean"])
    judged = given.mapInArrow(task(judge), schema)
    named = [F.col(n).alias(c) for c, n in zip(keep, inner, strict=True)]
    if only_kept:
        return judged.where("kept").select(*named)
    added = [*STATISTICS, "base_failed", "anomaly", "kept"]
    return judged.select(*[n for n, c in zip(named, keep, strict=True) if c not in added], *added)


def op5_forest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest, threshold = fit_forest(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, forest, threshold, ["doc_id"])
