"""Phrase collocation mining (operator 11).

Every word of a language has a 64-bit key, unique among all words of the corpus (checked; another
seed otherwise), so a phrase is one to four keys, the rest zero. Sketches come first: mappers
bincount hashed keys of one, two, three and four words into saturating numpy arrays, which are
tree-summed; a phrase all of whose parts lie in slots with ``least`` or more is a candidate, which
no phrase of that count can fail (Apriori). Candidates are dealt into blocks by hash; each block
gets a minimal perfect hash with its keys stored by slot. Mappers' occurrences of candidates,
combined before they move, meet the hash of their block, are verified against the stored keys and
bincounted, and the arrays are tree-summed. Counts of the parts of a phrase are then read by slot.

Any number of blocks takes the same passes over the texts: three. No task holds more than a block,
a slice of its occurrences and the sketches, whose size is bounded by ``MOST_BITS``.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.trees import LEAVES, tree_sum
from tessella.session import written

WORDS = 4  # of the longest phrase
LEAST, TOP, COVERED = 30, 2000, 80
#: Sketches have a slot for so many words of the corpus, and 2 ** MOST_BITS at most.
WORDS_PER_SLOT, LEAST_BITS, MOST_BITS = 32, 14, 26
SLICE = 1 << 20  # of a sketch, in slots
BLOCK_KEYS, GROUP_ROWS = 1 << 19, 1 << 20
CHUNK_WORDS = 1 << 20  # words that a mapper looks at together
HELD_ROWS = 1 << 20  # phrases that a mapper puts together before they move
_MEMO_WORDS, _MEMO_BYTES, _SLICE_BYTES = 300_000, 64, 1 << 20

#: A-Z to a-z, what ends a piece to a line feed, tabs to blanks.
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEYS = ["k1", "k2", "k3", "k4"]


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in parts of about _SLICE_BYTES that end between words."""
    at = 0
    while len(text) - at > _SLICE_BYTES:
        cut = text.find(b" ", at + _SLICE_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, some at a time; a full stop stands where a piece ends."""
    for part in _slices(text.translate(_FOLD).replace(b"\n", b" . ")):
        yield part.split()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        yield lang, text.as_py()


def _word_batches(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    held = 0

    def flushed():
        rows = [(lang, w, n) for lang, own in counts.items() for w, n in own.items() if w != b"."]
        kinds = (pa.string(), pa.binary(), pa.int64())
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in _rows(batch):
            own = counts.setdefault(lang, Counter())
            for words in words_of(text):
                held -= len(own)
                own.update(words)
                held += len(own)
                if held > most:
                    yield flushed()
                    own, held = counts.setdefault(lang, Counter()), 0
    yield flushed()


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, word, n)`` over all texts."""
    counted = _own(docs, lang_col, text_col).mapInArrow(_word_batches, "lang string, word binary, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _own(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang, text = F.col(lang_col).cast("string"), F.col(text_col).cast("string")
    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))


class _Memo(dict):
    """Keys by language of the words met; short words are held, _MEMO_WORDS in all at most."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed, self.held = seed, 0

    def __missing__(self, lang: str) -> _Keys:
        if self.held + len(self) >= _MEMO_WORDS:
            self.clear()
        self[lang] = own = _Keys(self, xxhash.xxh64_intdigest(lang.encode(), self.seed))
        return own

    def clear(self) -> None:
        for own in self.values():
            own.clear()
            own[b"."] = 0
        super().clear()
        self.held = 0


class _Keys(dict):
    """Keys of one language's words."""

    def __init__(self, memo: _Memo, seed: int):
        super().__init__()
        self.memo, self.seed = memo, seed
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        key = xxhash.xxh64_intdigest(word, self.seed)
        if len(word) <= _MEMO_BYTES:
            if self.memo.held >= _MEMO_WORDS:
                self.memo.clear()
            self[word] = key
            self.memo.held += 1
        return key


def _key_batches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    memo = _Memo(seed)
    for batch in batches:
        found = [memo[lang][w] for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64))], ["lang", "word", "n", "key"])


def keyed_words(words: DataFrame) -> tuple[DataFrame, int]:
    """``words`` with a ``key`` that no other word of any language has, none of them 0, and the seed that gives such keys."""
    seed = 0
    while True:
        keyed = written(words.mapInArrow(partial(_key_batches, seed=seed), "lang string, word binary, n long, key long"), "words")
        if keyed.groupBy("key").count().where("count > 1 or key = 0").isEmpty():
            return keyed, seed
        seed += 1


def _mixed(keys: list[np.ndarray], seed: int) -> np.ndarray:
    """A 64-bit hash of rows of keys."""
    h = np.full(len(keys[0]), seed * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1, np.uint64)
    for k in keys:
        h ^= k
        # The finaliser of the public 64-bit MurmurHash3.
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h ^= h >> np.uint64(33)
            h *= np.uint64(factor)
        h ^= h >> np.uint64(33)
    return h


def _slots(keys: list[np.ndarray], bits: int) -> np.ndarray:
    return (_mixed(keys, 1) >> np.uint64(64 - bits)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), kind)


def _sum_arrays(values: list[bytes], kind: str, cap: int | None = None) -> bytes:
    """Packed arrays summed, each entry up to ``cap``."""
    total = _unpacked(values[0], kind).astype(np.int64)
    for raw in values[1:]:
        total += _unpacked(raw, kind)
        if cap:
            np.minimum(total, cap, out=total)
    return _packed(total.astype(kind))


def _leaf_batch(level: int, total: np.ndarray) -> pa.RecordBatch:
    """The slices of one task's sketch of a level; ``part`` counts the slices of all levels."""
    n = max(1, len(total) // SLICE)
    cut = [_packed(x) for x in np.split(total, n)]
    parts, leaf = np.arange(n) + level * n, TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([leaf] * n, pa.int64()), pa.array(cut, pa.binary())], ["part", "leaf", "value"])


def _grown(total: np.ndarray, slots: np.ndarray, cap: int, weights: np.ndarray | None = None) -> None:
    more = np.bincount(slots, weights, len(total))
    np.minimum(more, cap, out=more)
    more += total
    np.minimum(more, cap, out=total, casting="unsafe")


def _sketch_words(batches: Iterator[pa.RecordBatch], bits: int, cap: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << bits, np.uint8)
    for batch in batches:
        keys = batch.column(0).to_numpy().view(np.uint64)
        _grown(total, _slots([keys], bits), cap, batch.column(1).to_numpy().astype(float))
    yield _leaf_batch(0, total)


def _streams(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[np.ndarray]:
    """Word keys of all texts in order, 0 where a piece ends, in chunks that share all but one word of a longest phrase.

    A phrase belongs to the chunk in which it starts before the last WORDS - 1 places.
    """
    memo = _Memo(seed)
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for lang, text in _rows(batch):
            keys = memo[lang]
            for words in words_of(text):
                held.append(np.fromiter(map(keys.__getitem__, words), np.uint64, len(words)))
                size += len(words)
                if size > CHUNK_WORDS:
                    whole = np.concatenate(held)
                    yield whole
                    held = [whole[1 - WORDS :]]
                    size = WORDS - 1
            held.append(np.zeros(1, np.uint64))
            size += 1
    yield np.concatenate([*held, np.zeros(WORDS - 1, np.uint64)])


def _phrases(keys: np.ndarray, maps: list[np.ndarray], bits: int, upto: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each length from 2: the keys and slots of phrases whose shorter parts are all in ``maps`` and that, if that length has a map, are in it."""
    n = len(keys) - WORDS + 1
    good = np.zeros(len(keys) + 1, bool)  # places where a phrase one word shorter starts
    good[:-1] = (keys != 0) & maps[0][_slots([keys], bits)]
    for k in range(2, upto + 1):
        starts = np.flatnonzero(good[:-1] & good[1:])
        own = [keys[starts + i] for i in range(k)]
        slots = _slots(own, bits)
        if k <= len(maps):
            kept = maps[k - 1][slots]
            starts, own, slots = starts[kept], [x[kept] for x in own], slots[kept]
        good = np.zeros(len(keys) + 1, bool)
        good[starts] = True
        here = starts < n  # the others belong to the next chunk
        yield [x[here] for x in own], slots[here]


def _unpack_maps(raw: list[bytes]) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).astype(bool) for x in raw]


def _sketch_phrases(batches: Iterator[pa.RecordBatch], shared, seed: int, bits: int, cap: int) -> Iterator[pa.RecordBatch]:
    maps = _unpack_maps(shared.value)
    totals = [np.zeros(1 << bits, np.uint8) for _ in range(WORDS - 1)]
    for keys in _streams(batches, seed):
        for total, (_, slots) in zip(totals, _phrases(keys, maps, bits, WORDS), strict=True):
            _grown(total, slots, cap)
    for level, total in enumerate(totals):
        yield _leaf_batch(level, total)


class _Held:
    """Phrases of one length and how often a task has met them; equal ones are put together whenever their rows have doubled."""

    def __init__(self):
        self.parts: list[list[np.ndarray]] = []  # of the keys of each word, and the times
        self.rows = self.combined = 0

    def add(self, own: list[np.ndarray]) -> None:
        self.parts.append([*own, np.ones(len(own[0]), np.int64)])
        self.rows += len(own[0])
        if self.rows > 2 * self.combined + HELD_ROWS // 4:
            self.combine()

    def combine(self) -> list[np.ndarray]:
        *own, times = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort(own)
        own = [x[order] for x in own]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(order)), bool), np.any([x[1:] != x[:-1] for x in own], axis=0)])
        out = [*(x[first] for x in own), np.add.reduceat(times[order], first) if len(first) else times]
        self.parts, self.rows, self.combined = [out], len(first), len(first)
        return out


def _occurrence_batches(batches: Iterator[pa.RecordBatch], shared, seed: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Candidates that a task has met, with their times; the keys of shorter phrases end in zeros. ``salt`` differs between the rows of a phrase."""
    maps = _unpack_maps(shared.value)
    held = [_Held() for _ in range(WORDS - 1)]
    turn = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        for k, one in enumerate(held, 2):
            *own, times = one.combine() if one.parts else [np.empty(0, np.int64)] * (k + 1)
            own = [x.view(np.int64) for x in own] + [np.zeros(len(times), np.int64)] * (WORDS - k)
            salt = np.full(len(times), TaskContext.get().partitionId() * 1_000_003 + turn, np.int64)
            for i in range(0, len(times), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (*own, times, salt)], [*_KEYS, "n", "salt"])
            held[k - 2] = _Held()
        turn += 1

    for keys in _streams(batches, seed):
        for one, (own, _) in zip(held, _phrases(keys, maps, bits, WORDS), strict=True):
            one.add(own)
        if sum(one.combined for one in held) > HELD_ROWS:
            yield from flushed()
    yield from flushed()


def _maps_of(leaves: DataFrame, levels: int, bits: int, least: int) -> list[bytes]:
    """The slots of each level with ``least`` or more, as packed bits: 2 ** bits bits a level."""
    parts = max(1, (1 << bits) // SLICE)
    found = {}
    for row in tree_sum(written(leaves, "sketch_leaves"), partial(_sum_arrays, kind="uint8", cap=least)).toLocalIterator():
        found[row.part] = np.packbits(_unpacked(bytes(row.value), np.uint8) >= least).tobytes()
    none = bytes((1 << bits) // parts // 8)
    return [zlib.compress(b"".join(found.get(level * parts + i, none) for i in range(parts)), 1) for level in range(levels)]


class PerfectHash:
    """A minimal perfect hash of rows of four keys, with the keys stored by slot.

    Keys that are alone at a place of a level's bits stay there, the others go on to the next
    level; the rank of its bit is a key's slot.
    """

    def __init__(self, keys: np.ndarray):
        self.bits: list[np.ndarray] = []
        left, level = list(keys.T.astype(np.uint64)), 0
        while len(left[0]):
            size = max(64, 2 * len(left[0]))
            at = (_mixed(left, level + 2) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left = [x[~alone[at]] for x in left]
            level += 1
        self._rank()
        self.keys = np.zeros_like(keys, dtype=np.uint64)
        self.keys[self._place(list(keys.T.astype(np.uint64)))] = keys

    def _rank(self) -> None:
        self.ranks, before = [], 0
        for bits in self.bits:
            self.ranks.append(np.cumsum(bits) + (before - 1))
            before += int(bits.sum())

    def _place(self, keys: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(keys[0]), -1, np.int64)
        left = np.arange(len(out))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = (_mixed([k[left] for k in keys], level + 2) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out

    def slots(self, keys: list[np.ndarray]) -> np.ndarray:
        """The slot of each row of keys, -1 for a row that isn't stored."""
        out = self._place(keys)
        known = np.flatnonzero(out >= 0)
        same = np.all([self.keys[out[known], i] == k[known] for i, k in enumerate(keys)], axis=0)
        out[known[~same]] = -1
        return out

    def dumped(self) -> bytes:
        return pickle.dumps(([len(b) for b in self.bits], [np.packbits(b).tobytes() for b in self.bits], self.keys.tobytes()))

    @classmethod
    def loaded(cls, raw: bytes) -> PerfectHash:
        own = cls.__new__(cls)
        sizes, bits, keys = pickle.loads(raw)
        own.bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, bits, strict=True)]
        own._rank()
        own.keys = np.frombuffer(keys, np.uint64).reshape(-1, WORDS)
        return own


def _key_columns(table: pa.Table) -> list[np.ndarray]:
    return [table.column(k).to_numpy().view(np.uint64) for k in _KEYS]


def _hash_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    own = PerfectHash(np.stack(_key_columns(table), axis=1))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "hash": pa.array([own.dumped()], pa.binary())})


def _count_block(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """Occurrences of one slice of a block, bincounted by slot."""
    schema = pa.schema([("part", pa.int64()), ("leaf", pa.int64()), ("value", pa.binary())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    own = PerfectHash.loaded(right.column("hash")[0].as_py())
    slots = own.slots(_key_columns(left))
    known = slots >= 0
    counts = np.zeros(len(own.keys), np.int64)
    np.add.at(counts, slots[known], left.column("n").to_numpy()[known])
    return pa.table([[key[0].as_py()], [key[1].as_py()], [_packed(counts)]], schema=schema)


def _read_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """Answers to one slice of a block's requests: the slot of a phrase and its count."""
    schema = pa.schema([("owner", pa.int64()), ("role", pa.int32()), ("whole", pa.int64()), ("slot", pa.int64()), ("value", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    own = PerfectHash.loaded(right.column("hash")[0].as_py())
    slots = own.slots(_key_columns(left))
    counts = _unpacked(right.column("counts")[0].as_py(), np.int64)
    values = [left.column(c).combine_chunks() for c in ("owner", "role", "whole")]
    ids = right.column("block")[0].as_py() * BLOCK_KEYS * 4 + slots
    return pa.table([*values, pa.array(ids), pa.array(counts[slots])], schema=schema).filter(pa.array(slots >= 0))


def _frequent_batches(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, raw, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = np.frombuffer(pickle.loads(raw)[2], np.int64).reshape(-1, WORDS)
            counts = _unpacked(packed, np.int64)
            at = np.flatnonzero(counts >= least)
            for i in range(0, len(at), 100_000):
                some = at[i : i + 100_000]
                columns = [some + block * BLOCK_KEYS * 4, *(np.ascontiguousarray(keys[some, j]) for j in range(WORDS)), counts[some]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", *_KEYS, "a"])


def _dealt(rows: DataFrame, salt: str, blocks: int) -> tuple[DataFrame, int]:
    """``rows`` with their block and a slice of it; the number of slices that keeps each under about GROUP_ROWS."""
    own = rows.withColumn("block", F.pmod(F.xxhash64(*_KEYS), F.lit(blocks)))
    most = own.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    slices = -(-most // GROUP_ROWS) or 1
    return own.withColumn("slice", F.pmod(F.xxhash64(salt, *_KEYS, F.lit(7)), F.lit(slices))), slices


def _for_slices(index: DataFrame, slices: int) -> DataFrame:
    return index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))


def phrase_index(occurrences: DataFrame, blocks: int) -> DataFrame:
    """``(block, hash, counts)``: the perfect hash of each block of the phrases in ``occurrences`` and the sums of their ``n`` by slot."""
    dealt, slices = _dealt(occurrences, "salt", blocks)
    hashes = written(dealt.select("block", *_KEYS).distinct().groupBy("block").applyInArrow(_hash_block, "block long, hash binary"), "hashes")
    left, right = dealt.groupBy("block", "slice"), _for_slices(hashes, slices).groupBy("block", "slice")
    leaves = left.cogroup(right).applyInArrow(_count_block, LEAVES)
    counts = tree_sum(written(leaves, "count_leaves"), partial(_sum_arrays, kind="int64")).select(F.col("part").alias("of_block"), F.col("value").alias("counts"))
    return written(hashes.join(counts, F.col("block") == F.col("of_block")).select("block", "hash", "counts"), "index")


# Parts of a phrase of so many words: role -> (first word, words). An even role is the left side of the
# cut after role / 2 + 1 words, an odd one the right side of the cut before it; -1: no side of a cut.
def _parts(k: int) -> list[tuple[int, int, int]]:
    cuts = [(2 * (c - 1), 0, c) for c in range(1, k)] + [(2 * (c - 1) + 1, c, k - c) for c in range(1, k)]
    sides = {(i, n) for _, i, n in cuts}
    return cuts + [(-1, i, n) for n in range(2, k) for i in range(k - n + 1) if (i, n) not in sides]


def _requests(phrases: DataFrame) -> DataFrame:
    """A row for each part of each phrase of two words or more."""
    length = sum((F.col(k) != 0).cast("int") for k in _KEYS)
    asked = F.lit(None)
    for k in range(2, WORDS + 1):
        parts = [
            F.struct(F.lit(role).alias("role"), *[(F.col(_KEYS[i + j]) if j < n else F.lit(0).cast("long")).alias(_KEYS[j]) for j in range(WORDS)])
            for role, i, n in _parts(k)
        ]
        asked = F.when(length == k, F.array(*parts)).otherwise(asked)
    return phrases.where("k2 <> 0").select(F.col("id").alias("owner"), F.col("a").alias("whole"), F.inline(asked))


def scored_phrases(index: DataFrame, blocks: int, least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """``(k1..k4, a, l, r, score)`` of the phrases of two words or more that no longer one covers."""
    phrases = written(index.mapInArrow(partial(_frequent_batches, least=least), "id long, k1 long, k2 long, k3 long, k4 long, a long"), "phrases")
    dealt, slices = _dealt(_requests(phrases), "owner", blocks)
    answers = dealt.groupBy("block", "slice").cogroup(_for_slices(index, slices).groupBy("block", "slice"))
    answers = written(answers.applyInArrow(_read_block, "owner long, role int, whole long, slot long, value long"), "answers")
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    # of each cut: left and right count; equal scores (after flooring) go to the shortest left side
    sides = answers.where("role >= 0").groupBy("owner", F.floor(F.col("role") / 2).alias("cut"), "whole").agg(
        F.max(F.when(F.col("role") % 2 == 0, F.col("value"))).alias("l"), F.max(F.when(F.col("role") % 2 == 1, F.col("value"))).alias("r"))
    score = F.call_function("div", exact("whole") * F.lit(2_000_000).cast("decimal(10,0)"), exact("l") + exact("r"))
    cuts = sides.withColumn("score", score).groupBy("owner").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    inside = answers.groupBy(F.col("slot").alias("owner")).agg(F.max("whole").alias("longer"))
    own = phrases.where("k2 <> 0").withColumnRenamed("id", "owner").join(cuts, "owner").join(inside, "owner", "left")
    kept = F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * covered)
    return own.where(kept).select(*_KEYS, "a", "least.l", "least.r", "least.score")


def mined(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the first ``top`` phrases of each language.

    Null texts have no words, a null language is ``und``; repeated rows count each. A text of any
    length is cut between words; one task holds a text, not its words. Other columns aren't read.
    Without words or phrases the result has no rows. Ties: score, then a, then the phrase's bytes.
    """
    if not 1 <= least <= 255:
        raise ValueError("least: from 1 to 255")
    spark = docs.sparkSession
    words, seed = keyed_words(written(word_counts(docs, lang_col, text_col), "word_counts"))
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (total // WORDS_PER_SLOT).bit_length()))
    frequent = words.where(F.col("n") >= least)
    maps = _maps_of(frequent.select("key", "n").mapInArrow(partial(_sketch_words, bits=bits, cap=least), LEAVES), 1, bits, least)
    own = _own(docs, lang_col, text_col)
    shared = spark.sparkContext.broadcast(maps)
    maps = maps + _maps_of(own.mapInArrow(partial(_sketch_phrases, shared=shared, seed=seed, bits=bits, cap=least), LEAVES), WORDS - 1, bits, least)
    shared.destroy()
    shared = spark.sparkContext.broadcast(maps)
    columns = ", ".join(f"{c} long" for c in (*_KEYS, "n", "salt"))
    phrases = own.mapInArrow(partial(_occurrence_batches, shared=shared, seed=seed, bits=bits), columns)
    zero = F.lit(0).cast("long")
    singles = frequent.select(F.col("key").alias("k1"), *[zero.alias(k) for k in _KEYS[1:]], "n", zero.alias("salt"))
    occurrences = written(phrases, "occurrences").unionByName(singles)
    shared.destroy()
    blocks = -(-occurrences.count() // block_keys) or 1  # no more keys than rows
    scored = scored_phrases(phrase_index(occurrences, blocks), blocks, least)

    names = frequent.select("key", "lang", F.col("word").cast("string").alias("word"))
    named = scored.join(names.withColumnRenamed("key", "k1").withColumnRenamed("word", "w1"), "k1")
    by_lang = Window.partitionBy("lang")
    # ties at the last place are settled by the phrases, which only those near the top get
    near = named.withColumn("near", F.rank().over(by_lang.orderBy(F.desc("score"), F.desc("a")))).where(F.col("near") <= top)
    near = written(near.drop("near"), "near_top")
    for i, k in enumerate(_KEYS[1:], 2):
        near = near.join(names.select(F.col("key").alias(k), F.col("word").alias(f"w{i}")), k, "left")
    near = near.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(1, WORDS + 1)]))
    rank = F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase"))
    sizes = words.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("n").alias("n"))
    ranked = near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, F.col("lang") == F.col("of_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
