"""Language identification (operator 9).

Sparse multinomial logistic regression on TF-IDF character n-grams (hashed into slots),
trained by follow-the-regularised-leader with elastic-net penalties and calibrated by a
temperature. Languages and document frequencies are counted over all training rows in two
distributed passes; the weights are fitted on a bounded sample (``per_language`` rows of
each language, ``SAMPLE_ROWS`` in all), hashed on the executors, so that only slot counts
reach the driver. There are ``2 ** BITS`` slots, and half as many for each doubling of the
languages beyond ``FULL_LANGUAGES``: the model's size is bounded for any number of labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import spare_name

BITS, ORDERS = 16, 4
UNKNOWN = "und"
PER_LANGUAGE, SAMPLE_ROWS = 700, 100_000  # documented bounds of the training sample: rows of a language, and of all
FULL_LANGUAGES = 400  # languages that a model of 2 ** BITS slots may have
LEAST_SCORE = 0.5  # confidence from which a document counts as written in a language
FEW = 100_000  # languages up to which their shares are broadcast
_BATCH = 8  # rows of one training step
_CHUNK = 1_000_000  # characters hashed at once by a task
_LETTER = regex.compile(r"\p{L}")
# Odd multipliers that spread the slots.
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def slot_bits(languages: int) -> int:
    """Bits of a slot: fewer for more than ``FULL_LANGUAGES`` languages, 8 at least."""
    return max(8, BITS - max(0, math.ceil(math.log2(max(1, languages) / FULL_LANGUAGES))))


def slots(codes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Slots of the 1- to 4-grams of code points: one row for each order, column i for the gram that starts at i.

    Callers put ``ORDERS`` blanks behind each text, so no gram runs into the next text.
    """
    out = np.empty((ORDERS, len(codes)), np.uint32)
    h = np.zeros(len(codes), np.uint32)
    for k in range(ORDERS):
        h[: len(codes) - k] += codes[k:] * np.uint32(_MIX[k])
        h *= np.uint32(_MIX[0])
        h ^= h >> np.uint32(15)
        out[k] = (h + np.uint32(k * 0x1F123BB5)) >> np.uint32(32 - bits)
    return out


def _codes(text: str) -> np.ndarray:
    """Folded code points between blanks, runs of white space as one."""
    folded = f" {' '.join(text.lower().split())}{' ' * ORDERS}"
    return np.frombuffer(folded.encode("utf-32-le", "replace"), np.uint32)


def _count_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Document frequencies of the rows of a task."""
    total, seen = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, bool)
    for batch in batches:
        for text in batch.column(0):
            seen[:] = False
            seen[slots(_codes(text.as_py()), bits)] = True
            total += seen
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["slot", "n"])


def _sample_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column(0):
            found, counts = np.unique(slots(_codes(text.as_py()), bits), return_counts=True)
            at.append(found.astype(np.int32))
            n.append(counts.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["lang", "row", "slots", "counts"])


@dataclass
class Model:
    """Weights with the inverse document frequencies folded in; one row for each slot."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated probability of each text; UNKNOWN and 0 where there is no letter."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.languages:
            return names, scores
        while known:
            part, held = [], 0
            while known and held < _CHUNK:
                part.append((i := known.pop(), _codes(texts[i])))
                held += len(part[-1][1])
            logits = self.logits([c for _, c in part]) / self.temperature
            p = softmax(logits)
            for (i, _), k, row in zip(part, p.argmax(axis=1), p, strict=True):
                names[i], scores[i] = self.languages[k], row[k]
        return names, scores

    def logits(self, codes: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(c) for c in codes])
        at = slots(np.concatenate(codes), int(len(self.weights)).bit_length() - 1)
        total = self.weights[at[0]]
        for k in range(1, ORDERS):
            total += self.weights[at[k]]
        sums = np.add.reduceat(total, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64)
        return sums / (ORDERS * lengths[:, None]) + self.bias


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], dims: int, classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of multinomial logistic regression over sparse rows (slots, values, class).

    A step takes the summed gradient of ``_BATCH`` rows. FTRL-proximal: each weight is the closed-form minimiser of its summed linear gradients
    with a per-coordinate quadratic and the elastic-net penalties; small ones are zero.
    """
    z, n = np.zeros((dims + 1, classes)), np.zeros((dims + 1, classes))
    r = np.random.default_rng(seed)

    def weights(at):
        own = z[at]
        return np.where(np.abs(own) <= l1, 0.0, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        order = r.permutation(len(rows))
        for k in range(0, len(order), _BATCH):
            part = [rows[i] for i in order[k : k + _BATCH]]
            # the entries of the batch by slot, each row's bias last
            at = np.concatenate([np.append(a, dims) for a, *_ in part])
            x = np.concatenate([np.append(v, 1.0) for _, v, _ in part])
            row = np.repeat(np.arange(len(part)), [len(a) + 1 for a, *_ in part])
            used, place = np.unique(at, return_inverse=True)
            w = weights(used)
            p = softmax(np.add.reduceat(x[:, None] * w[place], np.flatnonzero(np.diff(row, prepend=-1)), axis=0))
            p[np.arange(len(part)), [y for *_, y in part]] -= 1
            by = np.argsort(place, kind="stable")
            g = np.add.reduceat(x[by, None] * p[row[by]], np.flatnonzero(np.diff(place[by], prepend=-1)), axis=0)
            grown = n[used] + g * g
            z[used] += g - (np.sqrt(grown) - np.sqrt(n[used])) / alpha * w
            n[used] = grown
    w = weights(slice(None))
    return w[:dims], w[dims]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on a grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-300)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the rows of ``train`` with text and language; none at all give a model that knows no language.

    The sample takes about ``per_language`` rows of each language (fewer, but one at least, where that is more
    than ``sample_rows`` in all), chosen by a hash of id and text; equal rows count once in it. A fifth of it is
    kept from the weights and sets the temperature. Every label value is learned, however many there are.
    """
    own = train.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("row")).where("text is not null and lang is not null")
    counted = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("row").alias("different")).toArrow().to_pandas()  # one row for each language
    sizes = dict(zip(counted.lang, counted.different.astype(int), strict=True))
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    bits, languages = slot_bits(len(sizes)), sorted(sizes)
    terms = own.select("text").mapInArrow(partial(_count_batches, bits=bits), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    df = np.zeros(1 << bits)
    df[terms.slot.to_numpy()] = terms.n.to_numpy()
    idf = np.log((1 + counted.n.sum()) / (1 + df)) + 1
    each = min(per_language, max(1, sample_rows // len(sizes)))
    share = train.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in sizes.items()], "sampled_lang string, share double")
    if len(sizes) <= FEW:  # a row for each language: small enough for every task
        share = F.broadcast(share)
    chosen = own.join(share, F.col("lang") == F.col("sampled_lang")).where(F.pmod("row", F.lit(1_000_003)) < F.ceil(F.col("share") * 1_000_003))
    chosen = chosen.groupBy("lang", "row").agg(F.any_value("text").alias("text")).select("text", "lang", "row")
    sample = chosen.mapInArrow(partial(_sample_batches, bits=bits), "lang string, row long, slots array<int>, counts array<int>").toArrow()
    sample = sample.sort_by([("row", "ascending"), ("lang", "ascending")])
    rows, place = [], {k: i for i, k in enumerate(languages)}
    for lang, at, c in zip(sample["lang"].to_pylist(), sample["slots"], sample["counts"], strict=True):
        at, c = at.values.to_numpy(), c.values.to_numpy()
        rows.append((at, (c / c.sum() * idf[at]).astype(np.float32), place[lang]))
    # scale: rows of about unit length keep the step sizes meaningful
    scale = 1 / max(1e-12, float(np.mean([np.sqrt((x * x).sum()) for _, x, _ in rows]))) if rows else 1.0
    rows = [(at, x * scale, y) for at, x, y in rows]
    held = rows[::5] if len(rows) >= 50 else rows
    w, b = fit_ftrl([x for i, x in enumerate(rows) if i % 5 or len(rows) < 50], 1 << bits, len(languages))
    logits = np.array([x @ w[at] + b for at, x, _ in held]).reshape(len(held), len(languages))
    t = fit_temperature(logits, np.array([y for *_, y in held])) if len(languages) > 1 and held else 1.0
    return Model(languages, (w * idf[:, None] * scale).astype(np.float32), b, t)


def _predict_batches(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, scores = model.value.predict(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])


def _kept_batches(batches: Iterator[pa.RecordBatch], model, languages: frozenset | None, least: float, lang_at: int | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        names, scores = model.value.predict(texts)
        if model.value.languages:
            keep = [n != UNKNOWN and s >= least and (languages is None or n in languages) for n, s in zip(names, scores, strict=True)]
        else:
            keep = [bool(t and _LETTER.search(t)) for t in texts]
        columns = batch.columns[1:]
        if lang_at is not None and model.value.languages:
            columns[lang_at] = pc.coalesce(columns[lang_at], pa.array(names, columns[lang_at].type))
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[1:]).filter(pa.array(keep, pa.bool_()))


def _over(docs: DataFrame, text_col: str, keep: list[Column], step, more: str) -> DataFrame:
    own = docs.select(F.col(text_col).cast("string").alias(spare_name(docs, "text_in")), *keep)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(step, columns + more)


def predicted(docs: DataFrame, model: Model, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``, in one narrow pass.

    A null text or one without a letter has UNKNOWN and score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return _over(docs, text_col, keep, partial(_predict_batches, model=shared), ", lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", languages: Iterable[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` written in one of ``languages`` (None: in any that was learned) with a confidence of ``least`` or more.

    A null ``lang`` (a text column, if there is one) becomes the predicted language; all else stays as it is. Texts that are null or have no
    letter go. Where no language was learned, those with a letter stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang_at = next((i for i, f in enumerate(docs.schema.fields) if f.name == lang_col and f.dataType.simpleString() == "string"), None)
    step = partial(_kept_batches, model=shared, languages=None if languages is None else frozenset(languages), least=least, lang_at=lang_at)
    return _over(docs, text_col, [F.col(f"`{c}`") for c in docs.columns], step, "")


def held_out(id_col: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learn on the rows that aren't held out, predict every row."""
    model = fit(docs.where(~held_out(id_col)), text_col, lang_col, id_col, **options)
    return predicted(docs, model, text_col, [F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out")])
