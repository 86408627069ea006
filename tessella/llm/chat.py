"""Chat formatting (operator 4), in DataFrame functions only.

Logs hold snapshots: a conversation saved again and again as it grows. Cumulative-snapshot
collapse: every turn gets a hash of its place, role and text, and their rolling exclusive-or
identifies each turn-prefix of a conversation. A conversation whose whole hash is a prefix of
a longer one is left out by an anti-join; equal ones count once. Only hashes take part in
this; the texts of the conversations that stay are shuffled once, by conversation and chunk
of turns, and rendered there. Conversations of several chunks are put together from the
rendered chunks, a second shuffle of these only, so one very long conversation is no single
task's work until its one row is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import written

CHUNK = 256  # turns
# The rendered form of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows with a conversation and a place; ``a`` and ``b`` are two 64-bit hashes of a turn."""
    place = F.struct("turn", "role", "text")
    own = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = own.where("conv_id is not null and turn is not null")
    hashes = [F.xxhash64(F.lit(seed), place, F.col("role").isNull(), F.col("text").isNull()) for seed in (1, 2)]
    return own.select("*", F.floor(F.col("turn") / CHUNK).alias("chunk"), hashes[0].alias("a"), hashes[1].alias("b"))


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, a, b, last)``: the hash pair of each turn-prefix; ``last`` marks the whole conversation.

    Repeated rows count once. Rows without a conversation or a turn number are left out.
    """
    own = _turns(conversations).select("conv_id", "chunk", "turn", "a", "b").distinct()
    # one partitioning for all that follows
    turns = own.repartition("conv_id", "chunk").groupBy("conv_id", "chunk", "turn").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("n"))
    chunks = turns.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("ca"), F.bit_xor("b").alias("cb"), F.sum("n").alias("cn"), F.max("turn").alias("ct"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    chunks = chunks.select(
        F.col("conv_id").alias("of"),
        F.col("chunk").alias("part"),
        *[zero(F.bit_xor(c).over(before)).alias(f"{c}_before") for c in ("ca", "cb")],
        zero(F.sum("cn").over(before)).alias("n_before"),
        F.max("ct").over(whole).alias("stop"),
    )
    running = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    inside = turns.select("conv_id", "chunk", "turn", *[F.bit_xor(c).over(running).alias(c) for c in ("a", "b")], F.sum("n").over(running).alias("n"))
    joined = inside.join(chunks, (F.col("conv_id") == F.col("of")) & (F.col("chunk") == F.col("part")))
    return joined.select(
        "conv_id",
        "turn",
        F.col("a").bitwiseXOR(F.col("ca_before")).alias("a"),
        F.col("b").bitwiseXOR(F.col("cb_before")).alias("b"),
        (F.col("n") + F.col("n_before")).alias("n_turns"),
        (F.col("turn") == F.col("stop")).alias("last"),
    )


def _maximal(prefixes: DataFrame) -> DataFrame:
    ends = prefixes.where("last").groupBy("turn", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"), F.max("n_turns").alias("n_turns"))
    inner = prefixes.where("not last").select("turn", "a", "b").distinct()
    return ends.join(inner, ["turn", "a", "b"], "left_anti").select("conv_id", "n_turns", "n_copies")


def maximal(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of conversations that are no prefix of a longer one; the least id of equal ones."""
    return _maximal(written(turn_prefixes(conversations), "turn_prefixes"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def formatted(conversations: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies, text)``: each maximal conversation as one text.

    Turns come by number; several rows of one number by role, then text. Null roles and
    texts render as empty, but differ from empty ones when conversations are compared.
    """
    prefixes = written(turn_prefixes(conversations), "turn_prefixes")
    kept = _maximal(prefixes).withColumnRenamed("conv_id", "kept_id")
    chunks = prefixes.select("conv_id", F.floor(F.col("turn") / CHUNK).alias("kept_chunk")).distinct()
    n_chunks = F.count(F.lit(1)).over(Window.partitionBy("kept_id"))
    kept = written(chunks.join(kept, F.col("conv_id") == F.col("kept_id")).select("kept_id", "kept_chunk", "n_turns", "n_copies", n_chunks.alias("n_chunks")), "maximal")
    turns = _turns(conversations).select("conv_id", "chunk", "turn", "role", "text")
    of_kept = (F.col("conv_id") == F.col("kept_id")) & (F.col("chunk") == F.col("kept_chunk"))
    whole = ["conv_id", "n_turns", "n_copies"]

    def rendered(some: DataFrame) -> DataFrame:
        """A text for each chunk; repeated rows count once."""
        rows = F.array_sort(F.collect_set(F.struct("turn", "role", "text")))
        text = F.array_join(F.transform(rows, lambda t: _rendered(t["role"], t["text"])), "")
        return turns.join(some, of_kept).groupBy(*whole, "chunk").agg(text.alias("text"))

    short, long = rendered(kept.where("n_chunks = 1")), rendered(kept.where("n_chunks > 1"))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    long = long.groupBy(*whole).agg(F.array_join(F.transform(parts, lambda t: t["text"]), "").alias("text"))
    return short.select(*whole, "text").unionByName(long)
