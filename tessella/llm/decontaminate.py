"""Benchmark decontamination (operator 10).

A generalised suffix automaton of the normalised test items is built per block of items
(bounded by ``block_words``; a longer item is cut into pieces that share all but one word of a
window) in Spark tasks and broadcast, one at a time; training words are streamed through it,
tracking the longest match that ends at each word. A match of a window or more marks its
last words as hit. With one block the scan is a single narrow pass; with more, the rows
are written once under a generated key, one block's automaton is out at a time, and the
hits are merged by that key in a shuffle of spans: any number of blocks gives the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import spare_name, written

WINDOW = 13
COVERAGE = 20  # contaminated from one hit word in so many
BLOCK_WORDS = 100_000

#: A-Z to a-z, every other ASCII byte that is no letter or digit to a blank, the rest as it is.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


class SuffixAutomaton:
    """Every run of words of a set of items; a state holds the runs that end at the same places."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]
        short: list[tuple[list[int], object]] = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            last = 0
            for t in ids:
                last = self._extend(last, t, ends)
                ends[last].add(item)
            if 0 < len(ids) < window:
                short.append((ids, item))
        # the items of each state that holds runs of a window or more, handed down the links
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[v]] >= window:
                ends[self.link[v]] |= ends[v]
        self.items = [tuple(e) if self.length[v] >= window else () for v, e in enumerate(ends)]
        # items shorter than a window: whole runs, found at the state where they end
        self.short: dict[int, list[tuple[int, object]]] = {}
        for ids, item in short:
            v = 0
            for t in ids:
                v = self.next[v][t]
            self.short.setdefault(v, []).append((len(ids), item))
        self.least = min([window, *(len(ids) for ids, _ in short)])
        # shortcuts over the links: to the shortest runs of a window or more, and to the nearest whole short items
        self.whole, self.nearest = [0] * len(self.link), [0] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.whole[v] = self.whole[self.link[v]] if self.length[self.link[v]] >= window else v
            self.nearest[v] = v if v in self.short else self.nearest[self.link[v]]

    def _extend(self, last: int, t: int, ends: list[set]) -> int:
        def state(length, link, moves):
            self.length.append(length)
            self.link.append(link)
            self.next.append(moves)
            ends.append(set())
            return len(self.link) - 1

        def split(p, q):
            """The part of q that is reached from p by t, as a state of its own."""
            own = state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = own
            while p >= 0 and self.next[p].get(t) == q:
                self.next[p][t] = own
                p = self.link[p]
            return own

        q = self.next[last].get(t)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        fresh = state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = fresh
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[fresh] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return fresh

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (first word, end), merged and in order, and the items whose windows occur."""
        if len(words) < self.least:
            return [], set()
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.r_[0, ids >= 0, 0]))
        spans: list[tuple[int, int]] = []
        found: set = set()

        def hit(start, end):
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))

        window, moves, link, length, short = self.window, self.next, self.link, self.length, self.short
        ended = set()  # states whose items are found already
        for a, b in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if b - a < self.least:  # words outside the vocabulary end every match
                continue
            v = n = 0
            for i, t in enumerate(ids[a:b].tolist(), a + 1):
                while v and t not in moves[v]:
                    v = link[v]
                    n = length[v]
                v = moves[v].get(t, 0)
                n = n + 1 if v else 0
                if n >= window:
                    hit(i - window, i)
                    # runs of a window that end here, and those of longer runs, lie in items of this state
                    w = self.whole[v]
                    if w not in ended:
                        ended.add(w)
                        found.update(self.items[w])
                if short:  # at most one state for each length under a window
                    w = self.nearest[v]
                    while w:
                        for k, item in short[w]:
                            if k <= n:
                                hit(i - k, i)
                                found.add(item)
                        w = self.nearest[link[w]]
        return spans, found


def _scan(batches: Iterator[pa.RecordBatch], automaton) -> Iterator[pa.RecordBatch]:
    own: SuffixAutomaton = automaton.value
    for batch in batches:
        n_words, starts, ends, items = [], [], [], []
        for text in batch.column(1).cast(pa.binary()):
            words = words_of(text.as_py())
            spans, found = own.matches(words)
            n_words.append(len(words))
            starts.append([s for s, _ in spans])
            ends.append([e for _, e in spans])
            items.append(sorted(found, key=lambda x: (x is None, x or "")))
        arrays = [batch.column(0), pa.array(n_words, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "n_words", "starts", "ends", "items"])


def _piece_batches(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[pa.RecordBatch]:
    """Items as pieces of ``most`` words at most; every window of an item lies in one of its pieces."""
    step = max(1, most - window + 1)
    for batch in batches:
        rows: tuple[list, list, list] = ([], [], [])
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            words = words_of(text)
            for i in range(0, max(1, len(words) - window + 1), step) if len(words) > most else (0,) if words else ():
                piece = words[i : i + most] if len(words) > most else words
                rows[0].append(item)
                rows[1].append(b" ".join(piece))
                rows[2].append(len(piece))
        kinds = (pa.string(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["item", "piece", "n"])


def _automaton_batches(batches: Iterator[pa.RecordBatch], window: int, block_words: int) -> Iterator[pa.RecordBatch]:
    """Automata of the pieces of a task, each of ``block_words`` words at most (or one piece)."""

    def built(block):
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(SuffixAutomaton(block, window))], pa.binary())], ["automaton"])

    block, held = [], 0
    for batch in batches:
        for item, piece, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block and held + n > block_words:
                yield built(block)
                block, held = [], 0
            block.append((item, piece.split()))
            held += n
    if block:
        yield built(block)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[SuffixAutomaton]:
    """Automata of blocks of items, built by Spark tasks and written; the driver holds one at a time."""
    own = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    most = max(window, block_words)
    pieces = written(own.mapInArrow(partial(_piece_batches, window=window, most=most), "item string, piece binary, n long"), "pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total:
        blocks = -(-total * 5 // (4 * block_words)) if total > block_words else 1
        built = pieces.repartition(int(blocks)).mapInArrow(partial(_automaton_batches, window=window, block_words=block_words), "automaton binary")
        for row in written(built, "automata").toLocalIterator():
            yield pickle.loads(row.automaton)


def _merged(a, b):
    """Spans of several blocks, sorted by start, as disjoint spans."""
    return F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= b["start"]), F.concat(
        F.slice(a, 1, F.size(a) - 1),
        F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], b["end"]).alias("end"))),
    )).otherwise(F.concat(a, F.array(b)))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` written under a key of their own, and the key's name."""
    key = spare_name(docs, "row_key")
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _hits_by_row(own: DataFrame, blocks: Iterator[SuffixAutomaton]) -> DataFrame:
    """``own(row, text)`` with unique rows -> ``(row, n_words, starts, ends, items)`` over all blocks."""
    kind = own.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words long, starts array<long>, ends array<long>, items array<string>"
    every = None
    for a in blocks:
        shared = own.sparkSession.sparkContext.broadcast(a)
        scan = own.mapInArrow(partial(_scan, automaton=shared), schema)
        # the first block brings every row, the others those they hit
        scan = written(scan if every is None else scan.where("size(starts) > 0"), "hits")
        shared.destroy()
        every = scan if every is None else every.unionByName(scan)
    spans = F.sort_array(F.flatten(F.collect_list(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    hits = every.groupBy("row").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), found.alias("items"))
    hits = hits.withColumn("spans", F.aggregate("spans", empty, _merged))
    return hits.select("row", "n_words", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"), "items")


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(doc_id, n_words, starts, ends, items)``: hit word spans and the items found, per row of ``docs``.

    Null texts have no words. Items without words are left out; an item listed twice counts once. Items without
    id are matched like the others and count together as one item without a name (a null in ``items``).
    Every row is judged by itself, whatever its id.
    """
    own = docs.select(F.col(id_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    blocks = item_blocks(benchmark, item_id, item_text, window, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is not None:
        keyed, key = _keyed(own)
        hits = _hits_by_row(keyed.select(F.struct(key, F.col("row").alias("doc_id")).alias("row"), "text"), chain((first, second), blocks))
        return hits.select("row.doc_id", "n_words", "starts", "ends", "items")
    kind = own.schema["row"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, starts array<long>, ends array<long>, items array<string>"
    shared = docs.sparkSession.sparkContext.broadcast(first or SuffixAutomaton([], window))
    return own.mapInArrow(partial(_scan, automaton=shared), schema)


def _n_hit() -> Column:
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return total(F.col("ends")) - total(F.col("starts"))


def _over(coverage: int) -> Column:
    return (F.col("n_hit") > 0) & (coverage * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: int = COVERAGE, **options) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Contaminated: at least one word is hit, and one in ``coverage`` or more.
    """
    out = benchmark_hits(docs, benchmark, **options).withColumn("n_hit", _n_hit())
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        _over(coverage).alias("contaminated"),
    )


def _clean_batches(batches: Iterator[pa.RecordBatch], automaton, coverage: int) -> Iterator[pa.RecordBatch]:
    own: SuffixAutomaton = automaton.value
    for batch in batches:
        keep = []
        for text in batch.column(0).cast(pa.binary()):
            words = words_of(text.as_py())
            n = sum(e - s for s, e in own.matches(words)[0])
            keep.append(not n or coverage * n < len(words))
        yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).filter(pa.array(keep))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: int = COVERAGE, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, unchanged.

    One block of items: a narrow pass. Several: rows are left out by a written row key, never by id.
    """
    blocks = item_blocks(benchmark, "item_id", "text", window, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return docs
    if second is None:
        own = docs.select(F.col(text_col).cast("string").alias(spare_name(docs, "text_in")), *[F.col(f"`{c}`") for c in docs.columns])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
        return own.mapInArrow(partial(_clean_batches, automaton=docs.sparkSession.sparkContext.broadcast(first), coverage=coverage), columns)
    keyed, key = _keyed(docs)
    hits = _hits_by_row(keyed.select(F.col(key).alias("row"), F.col(text_col).cast("string").alias("text")), chain((first, second), blocks))
    bad_row = spare_name(keyed, "bad_row")
    bad = written(hits.withColumn("n_hit", _n_hit()).where(_over(coverage)).select(F.col("row").alias(bad_row)), "contaminated")
    return keyed.join(bad, F.col(key) == F.col(bad_row), "left_anti").drop(key)


def _without(raw: bytes, words: list[bytes], starts: list[int], ends: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    places, at, folded = [], 0, raw.translate(_FOLD)
    for w in words:
        at = folded.index(w, at)
        places.append((at, at + len(w)))
        at += len(w)
    kept, at = [], 0
    for s, e in zip(starts, ends, strict=True):
        kept.append(raw[at : places[s][0]])
        at = places[e - 1][1]
    return b"".join([*kept, raw[at:]])


def _cut_batches(batches: Iterator[pa.RecordBatch], automaton, coverage: int) -> Iterator[pa.RecordBatch]:
    """Texts without their hit words where the coverage limit is reached: spans of the automaton, or given as columns."""
    for batch in batches:
        texts, cuts = [], []
        given = None if automaton else [batch.column(k).to_pylist() for k in (2, 3)]
        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            raw = text.as_py()
            if given:  # only texts at or over the limit have spans
                starts, ends = given[0][i] or [], given[1][i] or []
                words = words_of(raw) if starts else []
            else:
                words = words_of(raw)
                spans = automaton.value.matches(words)[0]
                starts, ends = [s for s, _ in spans], [e for _, e in spans]
            n = sum(ends) - sum(starts)
            cuts.append(n if n and coverage * n >= len(words) else 0)
            if cuts[-1]:
                raw = _without(raw, words, starts, ends)
            texts.append(None if raw is None else raw.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(cuts, pa.int64())], ["doc_id", "text", "n_cut"])


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: int = COVERAGE, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, text, n_cut)``: texts at or over the coverage limit with their hit spans removed.

    The limit holds for the merged spans of all blocks of items; each original text is cut once.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string, n_cut long"
    blocks = item_blocks(benchmark, "item_id", "text", window, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return own.withColumn("n_cut", F.lit(0).cast("long"))
    if second is None:
        return own.mapInArrow(partial(_cut_batches, automaton=own.sparkSession.sparkContext.broadcast(first), coverage=coverage), schema)
    keyed, key = _keyed(own)
    hits = _hits_by_row(keyed.select(F.col(key).alias("row"), "text"), chain((first, second), blocks))
    bad = written(hits.withColumn("n_hit", _n_hit()).where(_over(coverage)).select("row", "starts", "ends"), "contaminated")
    spans = keyed.join(bad, F.col(key) == F.col("row"), "left").select("doc_id", "text", "starts", "ends")
    return spans.mapInArrow(partial(_cut_batches, automaton=None, coverage=coverage), schema)
