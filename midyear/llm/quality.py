"""Quality rules whose cutoffs are chosen under a risk bound; DataFrame functions only.

Each rule rejects documents whose statistic exceeds a cutoff from a fixed list. For
every stratum and rule, the distinct labelled good texts are a holdout (copies say
nothing new, so a text counts once, blanks aside): a cutoff is certified when the exact binomial test rejects that it loses more than its share of
``RISK`` of the good ones. Rules share RISK and, with the strata, ERROR equally
(Bonferroni); along a rule's list, from lenient to strict, losses only grow, so the
tests of one list form a fixed sequence and need no further correction. Hence, with
probability 1 - ERROR, in no stratum do the rules together reject more than RISK of
the good documents that pass the base rules. Of the certified cutoffs, the one
stays that rejects most labelled bad documents, each lost good one counted
``HARM`` times; a rule that gains nothing is off, as it is where labels are too few.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from midyear.functions.binding import let

from .common import BLANK, BLANK_CHARACTERS, ROW_KEY, keyed, sized_join, stored

RISK = 0.02
ERROR = 0.05
HARM = 10
MIN_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
# Statistic of a rule, and its cutoffs from lenient to strict.
RULES = {
    "symbols_per_word": (1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02),
    "repeated_word_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.17, 0.14, 0.11, 0.08, 0.05),
    "repeated_line_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "chars_per_word": (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5, 7.0),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that stand twice or more.

    Windows are sorted by hash; neighbours with equal hashes are compared word by word.
    """

    def body(w: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )

        def same(a: Column, b: Column) -> Column:
            equal = [F.get(w, a["i"] + j) == F.get(w, b["i"] + j) for j in range(3)]
            return F.coalesce((a["h"] == b["h"]) & reduce(lambda x, y: x & y, equal), F.lit(False))

        def covered(at: Column) -> Column:
            following = F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(1)))
            gaps = F.zip_with(at, following, lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0), lambda n, gap: n + gap)

        def repeated(s: Column) -> Column:
            return F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x))

        places = let(F.sort_array(hashed), lambda s: F.sort_array(F.transform(repeated(s), lambda x: x["i"])))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(places, covered))

    return let(words, body).cast("long")


def statistics(text: Column) -> Column:
    """Struct of the counts of one text."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANK_CHARACTERS, "") != "")
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda s: F.struct(
            s["w"]["n_words"].alias("n_words"),
            F.char_length(F.translate(text, BLANK_CHARACTERS, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            s["l"]["n_dup_lines"].alias("n_dup_lines"),
            s["w"]["n_repeat_words"].alias("n_repeat_words"),
            s["l"]["n_lines"].alias("n_lines"),
        ),
    )


def rule_value(rule: str) -> Column:
    per = {"symbols_per_word": ("n_symbols", "n_words"), "repeated_word_share": ("n_repeat_words", "n_words"), "repeated_line_share": ("n_dup_lines", "n_lines"), "chars_per_word": ("word_chars", "n_words")}
    over, under = per[rule]
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def most_losses(n: Column, risk: float, log_error: Column) -> Column:
    """The largest k with P(X <= k) <= error for X ~ Binomial(n, risk), or -1: losses that still certify a cutoff."""
    odds = math.log(risk) - math.log1p(-risk)
    start = F.struct((n * math.log1p(-risk)).alias("term"), F.lit(float("-inf")).alias("sum"), F.lit(-1).cast("long").alias("k"))

    def step(s: Column, i: Column) -> Column:
        high, low = F.greatest(s["sum"], s["term"]), F.least(s["sum"], s["term"])
        total = high + F.log1p(F.exp(low - high))
        following = s["term"] + F.log((n - i) / (i + 1)) + odds
        return F.struct(following.alias("term"), total.alias("sum"), F.when(total <= log_error, i).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * risk)), start, step, lambda s: s["k"])


def clear_labels(labels: DataFrame) -> DataFrame:
    """doc_id, quality, stored; ids with contradicting or null labels are left out."""
    clear = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality"), F.count(F.when(F.col("quality").isNull(), 1)).alias("unclear"))
    return stored(clear.where("low = quality and unclear = 0").select("doc_id", "quality"), "quality-labels")


def holdout_of(measured: DataFrame, clear: DataFrame) -> DataFrame:
    """One row per stratum and distinct text among the labelled rows that pass the base rules.

    Texts are distinct if they differ in more than blanks. Copies labelled alike are one
    observation, that of the least id; copies labelled differently are none.
    """
    labelled = sized_join(measured.where(~base_failed()), clear, ["doc_id"], "inner")
    one = F.min(F.struct("doc_id", "text_hash", *COUNTS, "n_lines")).alias("one")
    once = labelled.groupBy("stratum", "norm_hash").agg(one, F.min("quality").alias("low"), F.max("quality").alias("quality"))
    return once.where("low = quality").select("stratum", "quality", "one.*")


def cutoffs(measured: DataFrame, clear: DataFrame) -> DataFrame:
    """stratum and one column per rule with its cutoff, or null where the rule is off.

    ``measured``: doc_id, text_hash, norm_hash, stratum and the counts. ``clear``: as ``clear_labels`` gives them.
    """
    holdout = holdout_of(measured, clear)
    # How many cutoffs, counted from the strict end, a document exceeds.
    levels = [F.struct(F.lit(rule).alias("rule"), reduce(lambda a, b: a + b, [(rule_value(rule) > c).cast("int") for c in cuts]).alias("level")) for rule, cuts in RULES.items()]
    counted = holdout.select("stratum", "quality", F.explode(F.array(*levels)).alias("x")).groupBy("stratum", "x.rule", "x.level").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad"))
    list_of = Window.partitionBy("stratum", "rule")
    beyond = list_of.orderBy(F.desc("level"))
    table = stored(counted.select("*", F.sum("good").over(list_of).alias("n"), F.sum("good").over(beyond).alias("lost"), F.sum("bad").over(beyond).alias("caught")), "quality-counts")
    strata = max(1, table.select("stratum").distinct().count())
    log_error = F.lit(math.log(ERROR / (strata * len(RULES))))
    limits = stored(table.groupBy("stratum").agg(F.max("n").alias("n")).select("stratum", most_losses(F.col("n"), RISK / len(RULES), log_error).alias("limit")), "quality-limits")
    index = F.lit(None).cast("double")
    for rule, cuts in RULES.items():
        values = F.array(*[F.lit(c) for c in cuts])
        # A document at level x exceeds the x strictest cutoffs, so level x of the table is the cutoff before them.
        index = F.when(F.col("rule") == rule, F.get(values, len(cuts) - F.col("level"))).otherwise(index)
    gain = F.col("caught") - HARM * F.col("lost")
    certified = sized_join(table.where("level > 0"), limits, ["stratum"], "inner").where((F.col("lost") <= F.col("limit")) & (gain > 0))
    best = certified.withColumn("cutoff", index).groupBy("stratum", "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff"))["cutoff"].alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(rule) for rule in RULES])


def _measured(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of rows with a text, and its counts. The generator keeps them from being worked out anew for each use."""
    return rows.select(*columns, F.explode(F.array(statistics(F.col("text")))).alias("s")).select(*columns, "s.*")


def _keyed(docs: DataFrame, key: str, text: str, stratum: str, *more: Column) -> DataFrame:
    rows = keyed(docs, key, text, F.col(stratum).cast("string").alias("stratum"), *more)
    return rows.withColumn("norm_hash", F.xxhash64(F.translate("text", BLANK_CHARACTERS, "")))


def _limits(chosen: DataFrame) -> DataFrame:
    return stored(chosen.withColumnsRenamed({rule: f"max_{rule}" for rule in RULES}), "quality-cutoffs")


def _is_kept() -> Column:
    exceeds = reduce(lambda a, b: a | b, [F.coalesce(rule_value(rule) > F.col(f"max_{rule}"), F.lit(False)) for rule in RULES])
    return ~base_failed() & ~exceeds


def quality_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, text_hash.

    Null texts have no words and fail the base rules. Null strata are one stratum.
    Repeated ids share their labels; repeated rows get equal results, and certify no
    more than one of them does. Without labels, or with too few, only the base rules
    reject. A text's words are held as one array, so it may have some hundred million
    characters. Empty tables give empty results; other columns of ``docs`` and
    ``labels``, whatever their names, are ignored.
    """
    columns = [*ROW_KEY, "norm_hash", "stratum"]
    measured = stored(_measured(_keyed(docs, key, text, stratum), *columns), "quality-measured")
    limits = _limits(cutoffs(measured, clear_labels(labels)))
    judged = sized_join(measured, limits, ["stratum"], "left")
    return judged.select("doc_id", *COUNTS, base_failed().alias("base_failed"), _is_kept().alias("kept"), "text_hash")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names.

    The same verdicts as ``quality_verdicts``, but worked out in the row itself: only
    labelled rows are measured beforehand, and no text is shuffled. Nulls, repeated
    rows and empty tables as there.
    """
    columns = [*ROW_KEY, "norm_hash", "stratum"]
    rows, clear = _keyed(docs, "doc_id", "text", "lang"), clear_labels(labels)
    labelled = sized_join(rows, clear, ["doc_id"], "left_semi")
    limits = _limits(cutoffs(stored(_measured(labelled, *columns), "quality-labelled"), clear))
    whole = keyed(docs, "doc_id", "text", F.col("lang").cast("string").alias("stratum"), F.struct("*").alias("row"))
    return sized_join(_measured(whole, "stratum", "row"), limits, ["stratum"], "left").where(_is_kept()).select("row.*")
