"""Quality classifier (operator 3).

Histogram gradient-boosted trees over document statistics. One narrow pass turns each
whole text into a row of statistics, written once; the trees are fitted on a bounded
sample of labelled rows and flattened into arrays that numpy walks for a whole batch at
a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import written

SAMPLE = 20_000  # documented bound of the training sample: labelled rows
THRESHOLD = 0.3
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "marks", "symbols", "bangs", "bars", "other_bytes",
    "repeats", "distinct", "top_word", "lines", "line_words", "end_marks", "shouted", "worst_symbols", "worst_upper",
    "worst_bars", "worst_repeats", "bad_lines", "longest_word", "line_repeats",
)

_SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
_TO_BLANK = bytes(range(256))


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def _line_marks(line: bytes) -> tuple[float, float, float, float]:
    """Of a line's words: the share with symbols or bangs, upper-case, bars and repeats of the word before."""
    words = line.split()
    n = len(words)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marked = sum(w[-1] in b"#$%&*!" for w in words)
    return marked / n, upper / n, words.count(b"|") / n, sum(map(eq, words, words[1:])) / n


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole UTF-8 text, in the order of FEATURES; an empty text has zeros."""
    if not (words := text.split()):
        return [0.0] * len(FEATURES)
    n, m = len(text), len(words)
    upper = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    # neighbouring lines are judged together, so that a short line doesn't decide alone
    marks = np.array([_line_marks(x) for x in lines])
    weight = np.array([len(x) for x in lines], float)
    long = weight >= min(60.0, weight.max())
    worst = marks[long].max(axis=0)
    bad = (marks > (0.3, 0.5, 0.2, 0.3)).any(axis=1)
    return [
        np.log1p(n),
        np.log1p(m),
        sum(map(len, words)) / m,
        _share(upper, letters),
        (n - len(text.translate(None, b"0123456789"))) / n,
        (n - len(text.translate(None, b".,;:!?'\"()-"))) / n,
        (n - len(text.translate(None, _SYMBOLS))) / n,
        text.count(b"!") / m,
        text.count(b"|") / m,
        sum(map(text.count, (b"\xc3", b"\xc2"))) / n,
        sum(map(eq, words, words[1:])) / m,
        len(counts) / m,
        counts.most_common(1)[0][1] / m,
        np.log1p(len(lines)),
        m / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        sum(w.isupper() and len(w) > 1 for w in words) / m,
        *worst.tolist(),
        float((weight * bad).sum() / weight.sum()),
        max(map(len, words)),
        1 - len(set(lines)) / len(lines),
    ]


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], ["doc_id", *FEATURES])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and one double for each of FEATURES, per row; null counts as empty."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    columns = ", ".join(f"{f} double" for f in FEATURES)
    return own.mapInArrow(_statistics_batches, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, {columns}")


@dataclass
class Forest:
    """Complete binary trees of one depth as arrays: node k has children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; right if the value is greater
    leaf: np.ndarray  # trees x leaves
    start: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least_rows: float = 5.0) -> Forest:
    """Logistic boosting: each level splits its nodes by gradient histograms of binned statistics."""
    inner, leaves = 2**depth - 1, 2**depth
    prior = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    out = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(prior / (1 - prior))), depth)
    if not len(y) or y.min() == y.max():
        return Forest(out.feature[:0], out.cut[:0], out.leaf[:0], out.start, depth)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(n, out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for j in range(d):
                key = local * bins + binned[:, j]
                gs, hs, cs = (np.bincount(key, w, width * bins).reshape(width, bins) for w in (g, h, None))
                gl, hl, cl = (np.cumsum(a, axis=1)[:, :-1] for a in (gs, hs, cs))
                gt, ht, ct = (a.sum(axis=1, keepdims=True) for a in (gs, hs, cs))
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least_rows) | (ct - cl < least_rows)] = -1
                gain = gain[:, : len(edges[j])]
                if gain.shape[1] == 0:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for w in np.flatnonzero(top > best):
                    best[w] = top[w]
                    out.feature[t, first + w], out.cut[t, first + w] = j, edges[j][k[w]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.cut[t, node])
        at = node - inner
        out.leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        raw += out.leaf[t][at]
    return out


def _score_batches(batches: Iterator[pa.RecordBatch], forest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(forest.value.score(x))], ["doc_id", "held_out", "score"])


def held_out(id_col: str = "doc_id", modulus: int = 5, remainder: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Forest:
    """Fit on ``stats`` joined to ``labels`` by doc_id: all labelled rows, or about ``sample`` by a hash of the id."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("double").alias("label")).where("label is not null")
    share = min(1.0, sample / max(1, known.count()))
    known = known.where(F.abs(F.xxhash64("label_id") % 1_000_003) < int(share * 1_000_003) + 1)
    rows = stats.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", *FEATURES, "label").toArrow().to_pandas()
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable")
    return fit_forest(rows[list(FEATURES)].to_numpy(float), rows.label.to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; labels of held-out rows are never read.

    Null and empty texts are scored by statistics of zero. Without labels every score is 0.5;
    with labels of one kind only it is that kind's (clipped) share. Rows without an id are scored.
    """
    stats = written(document_statistics(docs, id_col, text_col), "statistics")
    forest = fit(stats, labels.where(~held_out("doc_id")), sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kind = stats.schema["doc_id"].dataType.simpleString()
    out = stats.select("doc_id", held_out().alias("held_out"), *FEATURES).mapInArrow(partial(_score_batches, forest=shared), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
