"""Secret scans (operator 1), in DataFrame functions only.

Each rule's regular expression is reduced to a Boolean trigram query: a text the rule can
match holds, case folded, all trigrams of at least one of the query's branches. The
trigrams of all queries are the terms of an inverted index: rows get a written key, and
each term a posting list for every block of ``2 ** BLOCK_BITS`` keys. A branch intersects
the lists of its trigrams, a query unites its branches; the keys that are left are the
rule's candidates, and only these are verified by the regular expression. A rule without a
mandatory trigram scans every row in full. Lists hold keys only, no text; blocks bound them,
whatever a term's frequency.

Patterns are taken apart by CPython's own (undocumented) parser of regular expressions.
"""

from __future__ import annotations

import re._constants as _c
import re._parser as _p
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import spare_name, written


@dataclass(frozen=True)
class Rule:
    """A pattern, the group that is the secret value (it ends the match) and the least length of that value."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules. For the last two a least count is the same as dropping short
# matches, as a match takes a maximal run; the first must take short values too, then drop them.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)

MASK = "[REDACTED]"
_MOST_STRINGS = 64  # alternatives of a query; a part with more counts as unknown
_PREFIX_CHUNK = 256
BLOCK_BITS = 16


def _strings(parsed) -> set[str] | None:
    """The folded strings that a parsed pattern matches, None if they are many or not plain."""
    out = {""}
    for kind, arg in parsed:
        if kind is _c.LITERAL:
            part = {chr(arg).lower()}
        elif kind is _c.IN and all(k is _c.LITERAL for k, _ in arg):
            part = {chr(x).lower() for _, x in arg}
        elif kind is _c.SUBPATTERN:
            part = _strings(arg[3])
        elif kind is _c.BRANCH:
            found = [_strings(x) for x in arg[1]]
            part = None if None in found else set().union(*found)
        elif kind is _c.MAX_REPEAT and arg[:2] in ((0, 1), (1, 1)):
            part = _strings(arg[2])
            part = part if part is None or arg[0] else part | {""}
        else:
            part = None
        if part is None or len(out) * len(part) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Branches of folded trigrams; every match of ``pattern`` has all trigrams of some branch.

    Taken from the run of consecutive parts that demands most. Empty: no trigram is
    mandatory. Only ASCII strings count, as only they fold alike everywhere.
    """
    best: list[frozenset[str]] = []
    run = {""}
    for part in [*_p.parse(pattern), None]:
        strings = _strings([part]) if part else None
        if strings is not None and len(run) * len(strings) <= _MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        branches = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(run) if s.isascii()]
        if len(branches) == len(run) and all(branches) and (not best or min(map(len, branches)) > min(map(len, best))):
            best = [b for b in dict.fromkeys(branches) if not any(other < b for other in branches)]  # the rest follow
        run = strings or {""}
    return best


def terms_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for branch in trigram_query(r.pattern) for t in branch})


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs``, written, with a key of its own for every row; keys of a task's rows follow each other."""
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def posting_lists(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``rows(row, text)`` -> the inverted index ``(term, block, rows)``: keys of the rows whose folded text holds the term."""
    terms = terms_of(rules)
    # the folded text is a column of its own, so that it is made once and not for every term
    folded = rows.select("row", F.lower("text").alias("folded"))
    has = F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in terms]).cast("array<string>")
    held = folded.select("row", F.explode(F.array_compact(has)).alias("term"))
    return held.groupBy("term", F.shiftright("row", BLOCK_BITS).alias("block")).agg(F.collect_list("row").alias("rows"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(row, rules)``: for each row that the Boolean query of some rule leaves, these rules as bits."""
    blocks = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("term", "rows"))).alias("lists"))
    lists = lambda t: F.coalesce(F.col("lists")[F.lit(t)], F.array().cast("array<bigint>"))
    left = []
    for k, rule in enumerate(rules):
        if branches := trigram_query(rule.pattern):
            found = [reduce(F.array_intersect, map(lists, sorted(b))) for b in branches]
            left.append(F.struct(F.lit(1 << k).cast("long").alias("rule"), reduce(F.array_union, found).alias("rows")))
    of_rule = F.array(*left) if left else F.array().cast("array<struct<rule:bigint,rows:array<bigint>>>")
    found = blocks.select(F.inline(of_rule)).select("rule", F.explode("rows").alias("row"))
    return found.groupBy("row").agg(F.bit_or("rule").alias("rules"))


def _with_candidates(rows: DataFrame, rules: tuple[Rule, ...], key: str, text_col: str, name: str) -> DataFrame:
    """``rows`` with the rules, as bits in the column ``name``, that each is a candidate of."""
    index = written(posting_lists(rows.select(F.col(key).alias("row"), F.col(f"`{text_col}`").alias("text")), rules), "postings")
    found = written(candidates(index, rules), "candidates")
    candidate_row = spare_name(rows, "candidate_row")
    found = found.select(F.col("row").alias(candidate_row), F.col("rules").alias(name))
    return rows.join(found, F.col(key) == F.col(candidate_row), "left").drop(candidate_row)


def _is_candidate(rule: Rule, k: int, name: str) -> Column:
    if not trigram_query(rule.pattern):
        return F.lit(True)
    return F.coalesce(F.col(name).bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(False))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _prefix_sums(steps: Column) -> Column:
    """For each i the sum of ``steps`` before i, by chunks: a long array isn't copied for each of its elements."""
    size = F.lit(_PREFIX_CHUNK)
    zero = F.lit(0).cast("long")
    running = lambda start, part: F.aggregate(
        part,
        F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("seen")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["seen"], acc["at"]).alias("seen")),
        lambda acc: acc["seen"],
    )

    def over(steps):
        parts = F.transform(F.sequence(F.lit(1), F.size(steps), size), lambda c: F.slice(steps, c, size))
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, lambda a, x: a + x))
        return F.flatten(F.zip_with(parts, running(zero, totals), lambda p, start: running(start, p)))

    return _let(steps, over)


def _spans(rule: Rule, rank: int, text: Column) -> Column:
    """Leftmost non-overlapping matches of a rule as ``(start, kind, end)`` in code points; none where it is no candidate."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    length = lambda x: F.char_length(x).cast("long")

    def spans(found):
        gaps = F.split(text, rule.pattern, -1)
        values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: length(g) + length(m))
        shifts = F.zip_with(_prefix_sums(steps), F.slice(gaps, 1, F.size(found)), lambda at, g: at + length(g))
        ends = F.zip_with(shifts, found, lambda at, m: F.struct(at.alias("start"), F.lit(rank).alias("kind"), (at + length(m)).alias("end")))
        kept = F.filter(F.arrays_zip(ends.alias("span"), values.alias("value")), lambda x: F.char_length(x["value"]) >= rule.least)
        return F.transform(kept, lambda x: x["span"])

    hit = _is_candidate(rule, rank, "rules") & F.regexp_like(text, pattern)
    return F.when(hit, _let(F.regexp_extract_all(text, pattern, F.lit(0)), spans)).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``: all secrets of every row, by start and then rule; ``kind`` is the rule's place in ``rules``.

    Matches of one rule don't overlap; those of different rules may. Null or empty texts
    have none; repeated rows come back as often as they occur.
    """
    own = keyed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")), "row")
    own = _with_candidates(own, rules, "row", "text", "rules")
    found = own.select("doc_id", *[_spans(r, k, F.col("text")).alias(f"kind_{k}") for k, r in enumerate(rules)])
    return found.select("doc_id", F.array_sort(F.concat(*[f"kind_{k}" for k in range(len(rules))])).alias("spans"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the count of each rule's spans, all spans as ``kind:start:end`` and their digest."""
    found = scan(docs, rules, id_col, text_col)
    names = F.array(*[F.lit(r.name) for r in rules])
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    found = found.select("doc_id", *[count(k).alias(f"n_{r.name}") for k, r in enumerate(rules)], listed.alias("spans"))
    return found.select("*", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret value replaced by ``mask``; rows without a secret stay as they are.

    Rules are applied one after another, each to its candidates and to rows that an earlier one changed; the
    mask matches none of the base rules.
    """
    key, name = spare_name(docs, "row_key"), spare_name(docs, "candidate_of")
    out = _with_candidates(keyed(docs, key), rules, key, text_col, name)
    text, changed = F.col(f"`{text_col}`"), spare_name(docs, "changed")
    out = out.withColumn(changed, F.lit(False))
    for k, rule in enumerate(rules):
        hit = (_is_candidate(rule, k, name) | F.col(changed)) & F.regexp_like(text, F.lit(rule.pattern))
        out = out.withColumns({text_col: F.when(hit, _hidden(text, rule, mask)).otherwise(text), changed: F.col(changed) | F.coalesce(hit, F.lit(False))})
    return out.select(*[f"`{c}`" for c in docs.columns])


def _hidden(text: Column, rule: Rule, mask: str) -> Column:
    found = [F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group)]
    matches = F.arrays_zip(found[0].alias("all"), found[1].alias("value"))

    def replaced(m):
        before = F.substring(m["all"], F.lit(1), F.char_length(m["all"]) - F.char_length(m["value"]))
        return F.when(F.char_length(m["value"]) >= rule.least, F.concat(before, F.lit(mask))).otherwise(m["all"])

    pieces = F.zip_with(F.split(text, rule.pattern, -1), F.transform(matches, replaced), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.array_join(pieces, "")
