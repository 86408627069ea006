"""Token counts by greedy longest match (operator 7).

The vocabulary is a trie over the characters of words with a mark at the word's end. Each
node carries a failure link and the number of pieces popped on following it: when no edge
fits, the longest pieces at the front of what has been read are given off at once and the
walk goes on from what is left. So a word's count needs one pass and no pieces are built.
The mark alone is a piece of no weight, so a word may also end in a piece without it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "\n"  # the end of a word in the trie; no word holds white space
#: A run of letters, a digit, or a run of other marks is a word.
WORDS = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_MEMO_ENTRIES, _MEMO_CHARS = 400_000, 64


class Matcher:
    """Longest-match automaton of a set of pieces; ``-1`` as a failure link means that no piece fits."""

    def __init__(self, pieces: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        final = [False]
        parent: list[tuple[int, str]] = [(0, "")]
        for piece in (END, *pieces):
            v = 0
            for c in piece:
                if c not in self.edges[v]:
                    self.edges[v][c] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                    parent.append((v, c))
                v = self.edges[v][c]
            final[v] = True
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        layer = [0]
        while layer:
            layer = [w for v in layer for w in self.edges[v].values()]
            for v in layer:
                up, c = parent[v]
                if final[v]:  # all that was read is one piece
                    self.fail[v], self.popped[v] = 0, int((up, c) != (0, END))
                    continue
                z, n = self.fail[up], self.popped[up]
                while z >= 0 and c not in self.edges[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.edges[z][c], n

    def count(self, word: str) -> int:
        """Number of pieces of a word; a word that pieces can't spell counts as one."""
        edges, fail, popped = self.edges, self.fail, self.popped
        v = n = 0
        for c in word:
            while c not in edges[v]:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return 1
            v = edges[v][c]
        while v > 0:
            n += popped[v]
            v = fail[v]
        return 1 if v < 0 else n


def _bytes_as_chars() -> dict[int, str]:
    """The vocabulary's spelling of bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b if b in plain else next(spare)) for b in range(256)}


@lru_cache(2)
def vocabulary(path: str) -> list[str]:
    """Pieces of a JSON vocabulary with ``</w>`` at word ends, with END in its place."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return [p.removesuffix("</w>") + END if p.endswith("</w>") else p for p in pieces if not p.startswith("<|")]


class _Memo(dict):
    def __init__(self, matcher: Matcher):
        self.matcher, self.spelling = matcher, _bytes_as_chars()

    def __missing__(self, word: str) -> int:
        n = self.matcher.count("".join(map(self.spelling.__getitem__, word.encode())) + END)
        if len(word) <= _MEMO_CHARS:
            if len(self) >= _MEMO_ENTRIES:
                self.clear()
            self[word] = n
        return n


@lru_cache(2)
def _memo(path: str) -> _Memo:
    return _Memo(Matcher(vocabulary(path)))


def count(text: str | None, path: str) -> tuple[int, int]:
    """Words and pieces of a text, lower-cased; null counts as empty."""
    words = regex.findall(WORDS, text.lower()) if text else []
    return len(words), sum(map(_memo(path).__getitem__, words))


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [count(t.as_py(), path) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))], ["key", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_tokens)`` of every row: whole texts in a single narrow pass.

    Null and empty texts have no words; repeated rows come back as often as they occur. Work is linear in a text's
    length, words of any length included. Other columns aren't read, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(partial(_count_batches, path=path), f"key {kind}, n_words long, n_tokens long").withColumnRenamed("key", id_col)
