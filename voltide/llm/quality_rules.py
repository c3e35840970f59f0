"""Quality rules: text statistics, then a hashed n-gram log-likelihood ratio of trusted text against the corpus.

The n-grams are the words and the pairs of neighbouring words, hashed into CELLS cells each. The target multinomial is
counted over trusted documents (labelled good, at most `rows` of them, by smallest draw) and mixed with a share FLOOR of
the raw one, which is counted over every document of the corpus. A document's verdict is the mean over its n-grams of
ln(p_target / p_raw), held against one fixed threshold. An n-gram that no trusted document has is worth ln(FLOOR),
whatever its raw count, so only the trusted documents' cells are kept: their number is bounded by `rows`.

Defined cases: a null or empty text has no words, fails the base rules and has a ratio of 0; without trusted
documents both multinomials are the same and the ratio is 0; repeated rows are judged each; an empty table gives an
empty result; further columns, whatever their names, are ignored or, by `keep`, left as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, identified, table, text_of, words_of

CELLS = 1 << 24
FLOOR = 0.05
WINDOW = 8  # a power of two
LEAST_WORDS = 20
REPEAT_PERCENT = 30
THRESHOLD = -2.0
TRUSTED_ROWS = 2000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _by_word(df: DataFrame) -> DataFrame:
    """A row for each of a text's `__words` (one without, for a text without words): the cells of the word, and of the pair with the next."""
    rest = F.slice("__words", 2, F.greatest(F.size("__words") - 1, F.lit(0)))
    # explode_outer: for a plain explode the optimizer would compute the arrays once more, in a filter below
    df = df.withColumn("__next", rest).withColumn("__gram", F.explode_outer(F.arrays_zip("__words", "__next")))
    word, after = F.col("__gram.__words"), F.col("__gram.__next")
    pair = F.when(after.isNotNull(), F.lit(CELLS) + F.pmod(F.xxhash64(word, after), F.lit(CELLS)))
    return df.withColumns({"__word": F.when(word.isNotNull(), F.pmod(F.xxhash64(word), F.lit(CELLS))), "__pair": pair}).drop("__words", "__next", "__gram")


def _grams(docs: DataFrame, text_col: str) -> DataFrame:
    """cell: every n-gram of all the documents."""
    grams = _by_word(docs.select(words_of(text_of(text_col)).alias("__words")))
    return grams.select(F.explode_outer(F.array("__word", "__pair")).alias("cell")).where("cell IS NOT NULL")


def trusted(docs: DataFrame, labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """Documents labelled good: the `rows` of them with the smallest crc32 of their id."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    ids = ids.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(rows)
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")  # `rows` bounds the broadcast


def fit(corpus: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """cell, ratio: ln(p_target / p_raw) of each cell that the target has, by kind of n-gram."""
    good = cut(_grams(target, text_col).groupBy("cell").agg(F.count(F.lit(1)).alias("good")))
    pair = F.col("cell") >= CELLS
    # raw counts of the target's cells, and of all others of a kind together (cell -1 and -2)
    known = _grams(corpus, text_col).join(F.broadcast(good.select("cell", F.lit(True).alias("__known"))), "cell", "left")
    raw = cut(known.groupBy(F.when(F.col("__known"), F.col("cell")).otherwise(F.when(pair, -2).otherwise(-1)).alias("cell")).agg(F.count(F.lit(1)).alias("raw")))
    kind = (F.col("cell") >= CELLS) | (F.col("cell") == -2)
    n_raw = raw.groupBy(kind.alias("pair")).agg(F.sum("raw").alias("n_raw"))
    n_good = good.groupBy(pair.alias("pair")).agg(F.sum("good").alias("n_good"))
    both = good.join(raw, "cell").withColumn("pair", pair).join(F.broadcast(n_raw), "pair").join(F.broadcast(n_good), "pair")
    share = (F.col("good") / F.col("n_good")) / (F.col("raw") / F.col("n_raw"))
    return cut(both.select("cell", F.log((1 - FLOOR) * share + FLOOR).alias("ratio")))


def _with_windows(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds one number for each run of WINDOW words, by doubling; a text's windows are compared with each other only."""
    df, width = df.withColumn("__run1", F.transform(words, lambda w: F.xxhash64(w))), 1
    while width < WINDOW:
        n, run = F.greatest(F.size(f"__run{width}") - width, F.lit(0)), f"__run{width}"
        df = df.withColumn(f"__run{2 * width}", F.zip_with(F.slice(run, 1, n), F.slice(run, 1 + width, n), lambda a, b: F.xxhash64(a, b))).drop(run)
        width *= 2
    return df.withColumnRenamed(f"__run{WINDOW}", out)


def _with_statistics(a: DataFrame) -> DataFrame:
    """Adds STATISTICS to rows of `__text` and `__words`.

    Each step is a column of its own, since an array that a later expression names twice would be computed twice.
    """
    a = _with_windows(a, "__words", "__windows")
    a = a.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count("__text", F.lit("[#*$%&|<>]")).cast("long"),
        "__lines": F.filter(F.split("__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    })
    # only texts that repeat a window sort theirs: equal neighbours in (window, place) order are repeats
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    a = a.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__sorted": F.when(repeats, F.array_sort(F.transform("__windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))),
    })
    a = a.withColumn("__places", F.array_sort(F.transform(F.filter("__sorted", lambda x, k: F.coalesce(x["w"] == F.get("__sorted", k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get("__sorted", k + 1)["w"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate("__places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")), lambda s: s["n"])
    return a.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__text", "__lines", "__windows", "__sorted", "__places")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row a document: doc_id, STATISTICS, base_failed, llr (the mean ratio of its n-grams), kept.

    A text's words are looked up in one pass and summed before anything is shuffled, so that one narrow row a document is.
    """
    unknown = F.lit(math.log(FLOOR)) if not ratios.isEmpty() else F.lit(0.0)  # without trusted text nothing tells texts apart
    a = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("__row"), text_of(text_col).alias("__text"))
    a = _by_word(_with_statistics(a.withColumn("__words", words_of(F.col("__text")))))
    # the trusted rows bound the cells
    of = lambda name, kind: F.broadcast(ratios.where(kind).select(F.col("cell").alias(f"{name}_cell"), F.col("ratio").alias(f"{name}_ratio")))
    a = a.join(of("__word", F.col("cell") < CELLS), F.col("__word") == F.col("__word_cell"), "left").join(of("__pair", F.col("cell") >= CELLS), F.col("__pair") == F.col("__pair_cell"), "left")
    worth = lambda name: F.when(F.col(name).isNotNull(), F.coalesce(f"{name}_ratio", unknown)).otherwise(0.0)
    a = a.groupBy("__row").agg(*[F.first(c).alias(c) for c in ("doc_id", *STATISTICS)], F.sum(worth("__word") + worth("__pair")).alias("total"))
    a = a.withColumn("llr", F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words") - 1)).otherwise(0.0)).withColumn("base_failed", base_failed())
    return a.select("doc_id", *STATISTICS, "base_failed", "llr", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"))


def keep(docs: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that all rules keep, with their own columns."""
    rows, row = identified(docs, text_col=text_col)
    kept = judge(rows, ratios, threshold, text_col, row).where("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratios = fit(docs, trusted(docs, table(spark, sf_dir, "labels")))
    return judge(docs, ratios).select("doc_id", *STATISTICS, "base_failed", "kept")
