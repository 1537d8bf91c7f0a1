"""Quality rules by distribution divergence, in DataFrame functions only.

Base rules: too few words, or too many words inside repeated 8-word windows.
Divergence rules: the Jensen-Shannon distance (base 2) between a document's
histogram and its language's reference histogram, for character classes and
for the language's common words. A reference is the mean of the histograms of
all documents of that language, so a long document weighs no more than a short
one. Documents below a minimum length are not judged by a divergence rule.
Texts are read once: the counts of each row go to the checkpoint folder, from
which both the references and the verdicts are taken.

Words are runs of characters other than space and \\x09-\\x0D. Null texts have
no words and fail the base rules. Null or unlisted languages share one
reference for character classes and have no common words. Equal rows give
equal results; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import materialize

WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Common words of each listed language.
COMMON = {
    "en": "the of and to in a is that for it was on are as with be by this".split(),
    "de": "der die das und ist von den mit zu ein eine nicht auf für im des sich auch".split(),
    "fr": "le la les de des et un une du en est que qui dans pour pas sur au".split(),
    "es": "el la los las de y que en un una del se con por para no es su".split(),
}
CLASSES = 6
#: Word characters and words from which the divergence rules judge a document.
MIN_CHARS_CLASS, MIN_WORDS_COMMON = 250, 80
#: Greatest distances of kept documents.
MAX_CLASS, MAX_COMMON = 0.28, 0.29


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, lang key, text, its words, these joined, histogram counts."""
    key = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit("other"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).withColumn("solid", F.array_join("words", ""))
    # character classes: what each step removes from what the step before left
    rest, counts = F.col("solid"), []
    for i, pattern in enumerate((r"[a-z]+", r"[A-Z]+", r"[0-9]+", r"[#*$%&|<>]+", r"\p{L}+")):
        rows = rows.withColumn(f"rest{i}", F.regexp_replace(rest, pattern, ""))
        counts.append(F.length(rest) - F.length(f"rest{i}"))
        rest = F.col(f"rest{i}")
    rows = rows.withColumn("classes", F.array(*[c.cast("double") for c in counts], F.length(rest).cast("double")))
    # few words are on any list: only those are counted one by one
    listed = sorted(set().union(*COMMON.values()))
    rows = rows.withColumn("listed", F.transform(F.filter("words", lambda w: F.lower(w).isin(listed)), lambda w: F.lower(w)))
    own = reduce(lambda c, k: c.when(F.col("key") == k, F.array(*map(F.lit, COMMON[k]))), COMMON, F.when(F.col("key") == "other", F.lit(None).cast("array<string>")))
    hits = F.transform(own, lambda w: (F.size("listed") - F.size(F.array_remove("listed", w))).cast("double"))
    none = F.array(*[F.lit(0.0)] * max(map(len, COMMON.values())))
    return rows.select("doc_id", "key", "text", "words", "solid", "classes", F.coalesce(hits, none).alias("common"))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: x / total)


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two histograms with equal totals."""

    def part(a: Column, b: Column) -> Column:
        term = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
        return (term(a) + term(b)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)))


def _histograms(rows: DataFrame) -> DataFrame:
    """Adds the shares of classes, and of common words with all other words last."""
    other = F.greatest(F.lit(0.0), F.col("n_words") - F.aggregate("common", F.lit(0.0), lambda s, x: s + x))
    total = F.greatest(F.lit(1.0), F.col("n_words").cast("double"))
    return rows.withColumn("p_class", _shares(F.col("classes"), F.greatest(F.lit(1.0), F.col("word_chars").cast("double")))).withColumn("p_common", _shares(F.concat("common", F.array(other)), total))


def references(rows: DataFrame) -> DataFrame:
    """One row for each listed language and one for all others: mean histograms of the measured documents long enough to judge."""
    rows = _histograms(rows)
    width = max(map(len, COMMON.values())) + 1
    judged = F.col("word_chars") >= MIN_CHARS_CLASS
    means = [F.avg(F.when(judged, F.col("p_class")[i])).alias(f"c{i}") for i in range(CLASSES)]
    means += [F.avg(F.when(F.col("n_words") >= MIN_WORDS_COMMON, F.col("p_common")[i])).alias(f"w{i}") for i in range(width)]
    return rows.groupBy("key").agg(*means).select("key", F.array(*[f"c{i}" for i in range(CLASSES)]).alias("q_class"), F.array(*[f"w{i}" for i in range(width)]).alias("q_common"))


def _repeated(words: Column) -> tuple[Column, Column]:
    """(hash of each window of WINDOW words, from the hashes `words`; positions covered by windows found twice, from `windows`)."""
    n = F.size(words)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return windows, n


def measure(docs: DataFrame) -> DataFrame:
    """The base measures and histograms of every row."""
    rows = _features(docs)
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows, _ = _repeated(F.col("hashes"))
    rows = rows.withColumn("windows", windows)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines)
    # only documents with an equal pair of windows sort them
    order = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("order", order)
    same = lambda x, k: F.coalesce(F.get("order", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("order", k + 1)["h"] == x["h"], F.lit(False))
    rows = rows.withColumn("found", F.array_sort(F.transform(F.filter("order", same), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    cover = F.aggregate("found", start, lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n")), lambda s: s["n"])
    return rows.select(
        "doc_id",
        "key",
        F.size("words").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        F.col("classes")[3].cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        "classes",
        "common",
    )


def judge(docs: DataFrame, max_class: float = MAX_CLASS, max_common: float = MAX_COMMON) -> DataFrame:
    """doc_id, the base measures, base_failed, js_class, js_common and kept of every row."""
    # texts are measured once: references and verdicts read the same counts
    rows, _ = materialize(measure(docs), "quality")
    # at most one row for each listed language and one more
    rows = _histograms(rows).join(F.broadcast(references(rows)), "key", "left")
    js_class = F.when(F.col("word_chars") >= MIN_CHARS_CLASS, _distance(F.col("p_class"), F.col("q_class")))
    js_common = F.when((F.col("n_words") >= MIN_WORDS_COMMON) & (F.col("key") != "other"), _distance(F.col("p_common"), F.col("q_common")))
    rows = rows.withColumn("js_class", F.coalesce(js_class, F.lit(0.0))).withColumn("js_common", F.coalesce(js_common, F.lit(0.0)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))
    # to 6 places, so that the order of a sum decides nothing
    kept = ~F.col("base_failed") & (F.round("js_class", 6) <= max_class) & (F.round("js_common", 6) <= max_common)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.round("js_class", 6).alias("js_class"), F.round("js_common", 6).alias("js_common"), kept.alias("kept"))
