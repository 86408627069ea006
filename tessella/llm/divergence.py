"""Quality rules by distribution divergence (operator 13), in DataFrame functions only.

A language's reference is the share of each character class in all its texts, and the shares of its
most common words. A document fails if its own shares lie farther from those of its language, by the
Jensen-Shannon distance (0 to 1), than a limit. Short documents and languages with few words aren't
judged by a histogram. Fixed base rules on length and repetition come first.

The table is read twice, once for the references (a row for each word of a language is shuffled,
counted before it moves) and once for the verdicts, a narrow pass: references are a few hundred
bytes for each language and are written first, so their size decides how they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import written

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30  # base rules; the last in per cent of the words
COMMON = 32  # words of a reference
MOST_LISTED = 4096  # common words of all languages that are looked up by hash; with more, every word meets its language's
#: Limits of the distances, and the least sizes from which a document or a reference counts.
CLASS_LIMIT, WORD_LIMIT = 0.25, 0.42
CLASS_CHARS, WORD_WORDS, REFERENCE_WORDS = 200, 50, 10_000

_SPACE = r"[\x20\x09-\x0D]+"
#: Classes in the order in which they are taken out of a text; what is left is the last class.
_CLASSES = ("[a-z]+", _SPACE, r"[^\x00-\x7F]+", """[.,;:!?'"()-]+""", "[A-Z]+", "[0-9]+")
_SYMBOLS = "[#*$%&|<>]+"
N_CLASSES = len(_CLASSES) + 1


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, wherever it stands in it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))


def _tail(items: Column) -> Column:
    return F.slice(items, 2, F.greatest(F.size(items), F.lit(1)))


def n_repeated(words: Column, window: int = WINDOW) -> Column:
    """Words in runs of ``window`` words (a power of two) that are found twice or more, the first included.

    Runs are compared by hash, and only in texts where a hash comes twice by their words.
    """

    def covered(places: Column) -> Column:
        gaps = F.zip_with(places, _tail(places), lambda x, y: F.least(F.coalesce(y - x, F.lit(window)), F.lit(window)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(runs: Column, words: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            equal = F.get(words, a) == F.get(words, b)
            for k in range(1, window):
                equal = equal & (F.get(words, a + k) == F.get(words, b + k))
            return equal

        ordered = F.sort_array(F.transform(runs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        pairs = _let(ordered, lambda s: F.zip_with(s, _tail(s), lambda x, y: F.when((x["g"] == y["g"]) & same(x["i"], y["i"]), F.array(x["i"], y["i"])).otherwise(F.array())))
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    def runs(hashes: Column, length: int) -> Column:
        """Hashes of runs of ``window`` from those of runs of ``length``, of which each is a few in a row; the last ones are cut short."""
        if length == window:
            return F.slice(hashes, F.lit(1), F.size(hashes) - (window - 1))
        parts = min(4, window // length)
        joined = F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k * length) for k in range(1, parts)]))
        return _let(joined, lambda h: runs(h, parts * length))

    def counted(words: Column) -> Column:
        hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: runs(h, 1))
        return _let(hashes, lambda r: F.when(F.size(F.array_distinct(r)) < F.size(r), _let(places(r, words), covered)).otherwise(F.lit(0).cast("long")))

    return _let(words, lambda w: F.when(F.size(w) > window, counted(w)).otherwise(F.lit(0).cast("long")))


def n_duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _class_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a count of each class and of symbols; every step works on what the one before left."""
    keep, left = df.columns, text
    for k, pattern in enumerate((*_CLASSES, _SYMBOLS)):
        df = df.withColumn(f"{text}_left{k}", F.regexp_replace(left, pattern, ""))
        df = df.withColumn(f"{text}_n{k}", (F.char_length(left) - F.char_length(f"{text}_left{k}")).cast("long"))
        left = f"{text}_left{k}"
    names = [f"{text}_n{k}" for k in range(N_CLASSES - 1)]
    rest = F.char_length(f"{text}_left{N_CLASSES - 2}").cast("long").alias("n_other")
    return df.select(*keep, F.array(*names, rest).alias("classes"), F.col(f"{text}_n{N_CLASSES - 1}").alias("n_symbols"))


def _own(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    texts = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), texts.alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base columns of each row, its ``classes`` and its ``words``."""
    counted = _class_counts(_own(docs, id_col, text_col, lang_col), "t")
    counted = counted.withColumn("words", words_of(F.col("t")))
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    return counted.select(
        "doc_id",
        "lang",
        "words",
        "classes",
        F.size("words").cast("long").alias("n_words"),
        (total - F.col("classes")[1]).alias("word_chars"),
        "n_symbols",
        n_duplicate_lines(F.col("t")).alias("n_dup_lines"),
        n_repeated(F.col("words")).alias("n_repeat_words"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return _let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, in millionths: 0 if equal, 1 if nothing is common."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    each = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.round(F.sqrt(F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)) / 2), 6)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> DataFrame:
    """``(lang, class_shares, common_words, word_shares, reference_words)`` over all texts of each language.

    ``word_shares`` has one place more than ``common_words``, for all other words. Words are lower-cased;
    equally common ones are taken in order.
    """
    own = _own(docs, text_col, text_col, lang_col).drop("doc_id")
    counted = _class_counts(own, "t")
    sums = [F.sum(F.col("classes")[k]).cast("double") for k in range(N_CLASSES)]
    classes = counted.groupBy("lang").agg(F.array(*sums).alias("class_counts"))
    words = written(own.select("lang", F.explode(words_of(F.lower("t"))).alias("word")).groupBy("lang", "word").count(), "word_counts")
    totals = words.groupBy(F.col("lang").alias("of_lang")).agg(F.sum("count").alias("reference_words"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = words.withColumn("place", order).where(F.col("place") <= common)
    listed = F.array_sort(F.collect_list(F.struct("place", "word", "count")))
    top = top.groupBy("lang").agg(listed.alias("top")).join(totals, F.col("lang") == F.col("of_lang"))
    top = top.select(
        F.col("lang").alias("of_lang"),
        F.col("top.word").alias("common_words"),
        F.col("top.count").cast("array<double>").alias("counts"),
        "reference_words",
    )
    others = F.col("reference_words") - F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    out = classes.join(top, F.col("lang") == F.col("of_lang"))
    return out.select("lang", _shares(F.col("class_counts")).alias("class_shares"), "common_words", _shares(F.concat("counts", F.array(others))).alias("word_shares"), "reference_words")


def _listed(refs: DataFrame) -> list[str] | None:
    """The common words of all languages, to be found by hash; None if they are too many to stand in a plan."""
    words = refs.select(F.explode("common_words").alias("word")).distinct().limit(MOST_LISTED + 1).collect()
    return [r.word for r in words] if len(words) <= MOST_LISTED else None


def distances(stats: DataFrame, refs: DataFrame) -> DataFrame:
    """``stats`` with ``class_distance`` and ``word_distance`` to the language's reference; null where it isn't judged."""
    joined = stats.join(refs.withColumnRenamed("lang", "ref_lang"), F.col("lang") == F.col("ref_lang"), "left")
    classes = js_distance(_shares(F.col("classes").cast("array<double>")), F.col("class_shares"))
    listed = _listed(refs)
    known = F.transform(F.col("words") if listed is None else F.filter(F.col("words"), lambda w: F.lower(w).isin(listed)), F.lower)
    found = _let(known, lambda k: F.transform("common_words", lambda r: F.size(k) - F.size(F.array_remove(k, r))))
    counts = _let(found, lambda c: F.concat(c, F.array(F.size("words") - F.aggregate(c, F.lit(0), lambda a, x: a + x))))
    words = js_distance(_shares(counts.cast("array<double>")), F.col("word_shares"))
    sound = F.col("reference_words") >= REFERENCE_WORDS
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    return joined.withColumn("class_distance", F.when(sound & (chars >= CLASS_CHARS), classes)).withColumn("word_distance", F.when(sound & (F.col("n_words") >= WORD_WORDS), words))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance)``.

    Every row is judged by itself, whatever its id. Null texts have no words and fail the base rule, as do
    empty ones; a null language is ``und``, with a reference of its own. A distance is null where the text,
    or its language's reference, is too small to be judged; such a text is kept if it passes the base rules.
    A distance at the limit is kept. Other columns aren't read. A text's words are held as arrays of one row,
    so one text may take some hundred bytes a word of a task's memory.
    """
    refs = written(references(docs, text_col, lang_col), "references")
    out = distances(statistics(docs, id_col, text_col, lang_col), refs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    far = lambda c, limit: F.coalesce(F.col(c) > limit, F.lit(False))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far("class_distance", CLASS_LIMIT) & ~far("word_distance", WORD_LIMIT))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
