"""Quality rules with adaptive thresholds.

Fixed cutoffs are replaced by fences that each language and source sets for itself. A relative-error quantile sketch, a
histogram of logarithmic buckets, is kept for each of them: its counts add up, so sketches merge in any order, before
the shuffle, and from sources into a language and into the whole. Quartiles read off the sketches, drawn towards those of
the wider group as far as few documents leave them unsure, give far-out fences, and documents are with the fences of their language and source. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import let, whole_text, written

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
MIN_WORDS = 50
#: Relative width of a bucket: quantiles are within 1 %.
GAMMA = 1.02
ZERO_BUCKET = -100_000
#: Documents that the wider group's quartiles weigh as much as: a source's are drawn towards its language's, and these
#: towards those of all documents.
PRIOR_DOCS = 50.0
#: Quartile ranges beyond the quartiles at which a fence stands.
FAR_OUT = 3.0
#: Metric: its least distance of fence and quartile, and whether there is a fence below, too.
METRICS = {"mean_word_chars": (2.0, True), "symbols_per_word": (0.15, False), "dup_line_share": (0.3, False), "repeat_share": (0.25, False)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of MEASURES, n_lines and base_failed added (columns of such names are replaced).

    A null or empty text has no words: all measures 0, base_failed. Windows are found by their 64-bit hash within a text;
    those of equal hash are compared word by word.
    """
    whole = whole_text(text)
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeated(w).alias("repeat")))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    df = docs.withColumns({"_w": of_words, "_l": of_lines, "n_symbols": F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("long")})
    df = df.withColumns({"n_words": F.col("_w.n"), "word_chars": F.col("_w.chars"), "n_lines": F.col("_l.n"), "n_dup_lines": F.col("_l.dup"), "n_repeat_words": F.col("_w.repeat")}).drop("_w", "_l")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _repeated(words: Column) -> Column:
    """Words in windows of three that are found again."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    # Most texts repeat no window; only the others are sorted.
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(hashed, lambda g: F.when(F.size(g) == F.size(F.array_distinct(g)), F.lit(0).cast("long")).otherwise(_covered(g, words))))


def _covered(grams: Column, words: Column) -> Column:
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def starts(p: Column) -> Column:
        window = lambda i: F.slice(words, i + 1, F.lit(3))
        same = lambda x, i: F.coalesce((F.get(p, i)["g"] == x["g"]) & (window(F.get(p, i)["i"]) == window(x["i"])), F.lit(False))
        return F.array_sort(F.transform(F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("e"))
    step = lambda a, i: F.struct((a["n"] + i + 3 - F.greatest(a["e"], i)).alias("n"), (i + 3).alias("e"))
    return let(pairs, lambda p: F.aggregate(starts(p), start, step, lambda a: a["n"]))


def _metric(name: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
    }[name]


def sketches(measured: DataFrame) -> DataFrame:
    """(level, lang, source, metric, bucket, docs) of documents that pass the base rules; level 1: whole languages, 2: all."""
    values = F.array(*(F.struct(F.lit(k).alias("metric"), _metric(k).alias("x")) for k in METRICS))
    bucket = F.when(F.col("m.x") <= 0, ZERO_BUCKET).otherwise(F.ceil(F.log("m.x") / F.log(F.lit(GAMMA)))).cast("int")
    fine = measured.where(~F.col("base_failed")).select("lang", "source", F.explode(values).alias("m")).groupBy("lang", "source", F.col("m.metric").alias("metric"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("docs"))
    levels = fine.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("level"), "lang", "source", "metric", "bucket", "docs").withColumns({"source": F.when(F.col("level") == 0, F.col("source")), "lang": F.when(F.col("level") < 2, F.col("lang"))})
    return levels.groupBy("level", "lang", "source", "metric", "bucket").agg(F.sum("docs").alias("docs"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, fences): for each metric a struct (low, high).

    A group's quartile q of n documents counts as (n q + PRIOR_DOCS w) / (n + PRIOR_DOCS), where w is its language's, and
    a language's likewise with that of all documents: one formula at every size.
    """
    group = ["level", "lang", "source", "metric"]
    # A sketch has a bounded number of buckets, so its array is small, whatever the data.
    buckets = sketch.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("bucket", "docs"))).alias("b"), F.sum("docs").alias("n"))

    def quantile(q: float) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("at"))
        at = F.aggregate("b", start, lambda a, x: F.struct((a["c"] + x["docs"]).alias("c"), F.when(a["at"].isNull() & (a["c"] + x["docs"] >= q * F.col("n")), x["bucket"]).otherwise(a["at"]).alias("at")), lambda a: a["at"])
        return F.when(at == ZERO_BUCKET, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), at) / (GAMMA + 1))

    known = F.struct(F.col("n").cast("double").alias("n"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3"))
    by_group = buckets.select("level", "lang", "source", "metric", known.alias("known")).groupBy("level", "lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", "known"))).alias("known"))
    by_group = written(by_group, "quality-quartiles")
    # One row of a few numbers, whatever the data.
    overall = {k: v for row in by_group.where("level = 2").select("known").collect() for k, v in row[0].items()}
    languages = by_group.where("level = 1").select(F.col("lang").alias("l"), F.col("known").alias("wide"))
    own = by_group.where("level = 0").join(languages, F.col("lang").eqNullSafe(F.col("l")), "left")

    def drawn(near: Column, far: Column | float) -> Column:
        return (near["n"] * near["q"] + PRIOR_DOCS * far) / (near["n"] + PRIOR_DOCS)

    def fence(metric: str) -> Column:
        least, below = METRICS[metric]
        if metric not in overall:
            return F.lit(None).cast("struct<low:double,high:double>")
        q1, q3 = (drawn(_named(F.col("known")[metric], q), drawn(_named(F.col("wide")[metric], q), F.lit(overall[metric][q]))) for q in ("q1", "q3"))
        reach = F.greatest(FAR_OUT * (q3 - q1), F.lit(least))
        return F.struct((q1 - reach if below else F.lit(None).cast("double")).alias("low"), (q3 + reach).alias("high"))

    return own.select("lang", "source", F.struct(*(fence(m).alias(m) for m in METRICS)).alias("fences"))


def _named(known: Column, quartile: str) -> dict[str, Column]:
    return {"n": known["n"], "q": known[quartile]}


def verdicts(measured: DataFrame, fenced: DataFrame) -> DataFrame:
    """measured with ``kept``: false if base_failed or a metric lies beyond a fence of its language and source."""
    other = fenced.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("fences").alias("_fences"))
    joined = measured.join(other, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    beyond = F.lit(False)
    for name in METRICS:
        fence = F.col("_fences")[name]
        beyond = beyond | F.coalesce((_metric(name) > fence["high"]) | F.coalesce(_metric(name) < fence["low"], F.lit(False)), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~beyond).drop("_lang", "_source", "_fences")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, measures, base_failed, kept) for every row.

    Fences are those of the row's language and source, as fences() says. Null languages and sources are a group of their own. Repeated rows each keep theirs, and null keys too; other
    columns are not read. An empty table gives an empty one. Texts are read once: the measures, a few numbers a row, are
    written before the sketches are taken from them.
    """
    renamed = docs.select(F.col(key).alias("_key"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text"))
    measured = written(measure(renamed).drop("text"), "quality-measures")
    return verdicts(measured, fences(sketches(measured))).select(F.col("_key").alias(key), *MEASURES, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of documents that judge() keeps, columns unchanged, whatever they are called; nulls as in judge(). Reads
    texts twice rather than shuffling them."""
    fenced = fences(sketches(written(measure(docs.select("lang", "source", "text")).drop("text"), "quality-measures")))
    whole_row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    measured = measure(docs.select("lang", "source", "text", whole_row))
    # The filter on the verdict stops at the generator; pushed below it, it would take the measures again for each use.
    held = F.explode(F.array(F.struct(*MEASURES, "n_lines", "base_failed"))).alias("_m")
    once = measured.select("lang", "source", "_row", held).select("lang", "source", "_row", "_m.*")
    return verdicts(once, written(fenced, "quality-fences")).where("kept").select("_row.*")
