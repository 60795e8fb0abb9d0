"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Method. Fixed base rules come first. Beside them each measure gets a
threshold of its own in every language and source, read from a quantile
sketch: counts of logarithmic buckets, whose merge is an addition, with a
relative error of at most ``GAMMA`` - 1 in any quantile. The sketch of each
source is merged with its language's, scaled to ``PRIOR`` rows, and that of
each language with everything's, so small groups lean on larger ones and no
group changes its rule at some size. The fence of a measure lies ``REACH`` times
as far from the median as the outer decile does. A document fails where a
measure lies beyond its fence and, if it counts something, at least ``EVENTS``
of it are there; thresholds meet documents in a join.

All of it is DataFrame functions. Sketches are pre-aggregated before their
exchange, so a source with a third of all rows costs no more than another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import written

#: Ratio of the bounds of a sketch's bucket.
GAMMA = 1.02
#: Rows that a parent's sketch counts for in its child's.
PRIOR = 200
#: Fence: this many times the distance from the median to the outer decile.
REACH = 7
#: Measures, with what they count; the first is an average and has a lower fence too.
MEASURES = {"word_length": None, "symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words"}
#: Fewer symbols, lines or words than this are no evidence, however short the text that they are a share of.
EVENTS = 10

_SPACE = r"[ \t-\r]+"
_SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text; none where it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The counts of each document, computed row by row without an exchange.

    Words in repeated 3-word windows: windows are hashed and, only where two
    hashes of the text agree, sorted with their places; a place whose
    neighbour has the same hash is a repeat, and repeats cover up to three
    words each.
    """
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    df = df.select("doc_id", "lang", "source", words_of(F.col("text")).alias("words"), lines.alias("lines"), (F.length("text") - F.length(_without(F.col("text"), _SYMBOLS))).alias("symbols"))
    df = df.select(
        "doc_id", "lang", "source",
        F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), F.coalesce("symbols", F.lit(0)).alias("n_symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr("transform(sequence(0, size(words) - 3, if(size(words) < 3, -1, 1)), i -> if(size(words) < 3, i, xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))))").alias("grams"),
    )
    repeated = (F.col("n_words") >= 3) & (F.size(F.array_distinct("grams")) < F.size("grams"))
    df = df.withColumn("placed", F.when(repeated, F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array())).drop("grams")
    df = df.withColumn("places", F.expr("array_sort(transform(filter(placed, (p, j) -> p.h <=> get(placed, j - 1).h or p.h <=> get(placed, j + 1).h), p -> p.i))")).drop("placed")
    return df.select(
        "doc_id", "lang", "source", *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")),
        F.expr("aggregate(places, named_struct('n', 0, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)").cast("long").alias("n_repeat_words"),
    )


def _values() -> dict[str, Column]:
    def share(part: str, whole: str, times: int) -> Column:
        return F.when(F.col(whole) > 0, F.floor(F.col(part) * times / F.col(whole)))

    return dict(zip(MEASURES, (share("word_chars", "n_words", 100), share("n_symbols", "n_words", 1000), share("n_dup_lines", "n_lines", 1000), share("n_repeat_words", "n_words", 1000)), strict=True))


def sketches(df: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: sums of n over any rows are the sketch of those rows' union."""
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("v")) for k, v in _values().items())))
    df = df.where("n_words > 0").select("lang", "source", rows.alias("m")).where("m.v is not null")
    bucket = F.floor(F.log(F.col("m.v") + 1) / F.log(F.lit(GAMMA))).cast("int")
    return df.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source, and the fences of each measure."""
    own = sketch.select(F.col("lang").alias("l"), F.col("source").alias("s"), "measure", "bucket", "n")
    every = _shares(own.groupBy("measure", "bucket").agg(F.sum("n").alias("n")), "measure")
    lang = own.groupBy("l", "measure", "bucket").agg(F.sum("n").alias("n"))
    lang = _shares(_with_prior(lang, every, ["l"], []), "l", "measure")
    merged = _with_prior(own, lang, ["l", "s"], ["l"])
    of = Window.partitionBy("l", "s", "measure")
    merged = merged.withColumn("upto", F.round(F.sum("n").over(of.orderBy("bucket")), 6)).withColumn("total", F.sum("n").over(of))

    def bucket(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.round(F.col("total") * q, 6), F.col("bucket")))

    cut = merged.groupBy("l", "s", "measure").agg(bucket(0.1).alias("b1"), bucket(0.5).alias("b5"), bucket(0.9).alias("b9"))

    def edge(c: str, upper: int) -> Column:
        return F.pow(F.lit(GAMMA), F.col(c) + upper) - 1

    most = edge("b5", 1) + (edge("b9", 1) - edge("b5", 1)) * REACH
    least = edge("b5", 0) - (edge("b5", 0) - edge("b1", 0)) * REACH
    cut = cut.select("l", "s", "measure", most.alias("most"), least.alias("least"))
    sides = (F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{side}_{k}") for k in MEASURES for side in ("least", "most"))
    return cut.groupBy(F.col("l").alias("lang"), F.col("s").alias("source")).agg(*sides)


def _shares(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with p, the share of n within the keys."""
    return rows.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def _with_prior(rows: DataFrame, parent: DataFrame, keys: list[str], common: list[str]) -> DataFrame:
    """Sketches (keys, measure, bucket, n) with their parent's share p of ``PRIOR`` rows added; ``common`` are the keys of the parent."""
    held = parent.select(*(F.col(c).alias(f"p_{c}") for c in common), F.col("measure").alias("p_measure"), F.col("bucket"), (F.col("p") * PRIOR).alias("n"))
    same = F.col("measure") == F.col("p_measure")
    for c in common:
        same &= F.col(c).eqNullSafe(F.col(f"p_{c}"))
    added = rows.select(*keys, "measure").distinct().join(held, same).select(*keys, "measure", "bucket", "n")
    return rows.select(*keys, "measure", "bucket", F.col("n").cast("double")).unionByName(added).groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, base rule and verdict of each document.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and outside (the measures that lie beyond a fence).

    Defined cases: a null or empty text has no words and fails the base rule;
    null languages and sources are groups of their own; repeated rows count
    each; ties fall into one bucket; very long texts are measured whole; an empty table gives none; columns other
    than those named are ignored.
    """
    counts = written(measured(docs, id_col, text_col, lang_col, source_col), "measures")
    fences = written(thresholds(sketches(counts)), "fences").withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    df = counts.join(fences, F.expr("lang <=> f_lang and source <=> f_source"), "left")
    values = _values()
    enough = {k: F.col(count) >= EVENTS if count else F.lit(True) for k, count in MEASURES.items()}
    out = [F.when((v > F.col(f"most_{k}")) & enough[k], F.lit(k)) for k, v in values.items()]
    out.append(F.when(values["word_length"] < F.col("least_word_length"), F.lit("word_length")))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    df = df.withColumn("outside", F.array_compact(F.array(*out))).withColumn("base_failed", failed)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("outside") == 0)).alias("kept"), "outside")
