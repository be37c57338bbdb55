"""Quality rules as one native projection: a threshold table compiled into Spark expressions, no user functions.

Defined results: a null or empty text has no words, fails the base rule and isn't kept; repeated rows each get their
row; a ratio that equals a limit is inside it; texts of any length are judged whole; an empty table gives no rows; only
key and text are read, so other columns may have any name. Words are runs of characters other than space and code points 9 to 13.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus languages, for the ratio of stop words.
STOP_WORDS = (
    "the of and to in is that it was for on are as with be at by this have from or an not but had were they which "
    "der die und von zu den das ist im dem nicht ein eine mit sich auf des für "
    "de la le et les des en un une du que est dans pour par sur au il qui "
    "el los las una por con para su no se lo como más y o a"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A ratio, and the range in which a document is kept; either end may be open. From `least_words` words on."""

    metric: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: The table. Ratios are judged only where there are words enough for them to mean something.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0, 10),
    Rule("symbol_ratio", None, 0.10, 10),
    Rule("stop_ratio", 0.01, None, 50),
    Rule("dup_line_ratio", None, 0.50, 10),
    Rule("letter_ratio", 0.50, None, 10),
    Rule("bullet_line_ratio", None, 0.90, 50),
    Rule("ellipsis_line_ratio", None, 0.30, 50),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression from the table; an undefined ratio passes."""
    verdict = F.lit(True)
    for r in rules:
        inside = F.lit(True)
        if r.low is not None:
            inside = inside & (F.col(r.metric) >= r.low)
        if r.high is not None:
            inside = inside & (F.col(r.metric) <= r.high)
        verdict = verdict & ((F.col("n_words") < r.least_words) | F.coalesce(inside, F.lit(True)))
    return verdict


def rule_metrics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts and the ratios of the table, for every whole text; only key and text are read.

    Equal windows have equal hashes, so where all hashes of a text differ no window repeats and nothing more is done.
    Else the windows whose hash another one has are sorted as (words, place), neighbours compared word by word, and the
    runs that the places cover are measured.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    t = df.select(F.col(key).alias("doc_id"), body.alias("t"))
    blank = "[\\x20\\x09-\\x0D]+"
    t = t.select("doc_id", "t", F.filter(F.split("t", blank), lambda w: w != "").alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    t = t.select("*", F.size("words").alias("n"))
    starts = F.sequence(F.lit(0), F.col("n") - WINDOW)
    at = lambda column, i: [F.get(column, i + k) for k in range(WINDOW)]
    t = t.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("keys"))
    t = t.select("*", F.when(F.col("n") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*at("keys", i)))).otherwise(F.array().cast("array<bigint>")).alias("hashes"))
    # Only documents in which a hash repeats go on; the others have no repeated window.
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    t = t.select("*", F.when(again, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    near = lambda x, i, d: F.get(F.col("sorted"), i + d)["h"] == x["h"]
    t = t.select("*", F.filter("sorted", lambda x, i: F.coalesce(near(x, i, -1), F.lit(False)) | F.coalesce(near(x, i, 1), F.lit(False))).alias("alike"))
    t = t.select("*", F.array_sort(F.transform("alike", lambda x: F.struct(F.concat_ws(" ", *at("words", x["i"])).alias("w"), x["i"].alias("i")))).alias("exact"))
    same = lambda x, i, d: F.get(F.col("exact"), i + d)["w"] == x["w"]
    t = t.select("*", F.array_sort(F.transform(F.filter("exact", lambda x, i: F.coalesce(same(x, i, -1), F.lit(False)) | F.coalesce(same(x, i, 1), F.lit(False))), lambda x: x["i"])).alias("places"))
    covered = F.aggregate(
        F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("places"), i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x
    )
    word_chars = F.length(F.array_join("words", ""))
    lines, n = F.size("lines"), F.col("n")
    ratio = lambda a, b: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    stops = F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS)))
    return t.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        ratio(word_chars, n).alias("mean_word_chars"),
        ratio(stops, n).alias("stop_ratio"),
        ratio(word_chars - F.length(F.regexp_replace(F.array_join("words", ""), "\\p{L}+", "")), word_chars).alias("letter_ratio"),
        ratio(F.size(F.filter("lines", lambda x: x.rlike("^\\s*[-*•]"))), lines).alias("bullet_line_ratio"),
        ratio(F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))), lines).alias("ellipsis_line_ratio"),
        lines.alias("n_lines"),
    )


def quality_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the ratios."""
    m = rule_metrics(df, key, text)
    m = m.select("*", (F.col("n_symbols") / F.nullif(F.col("word_chars").cast("double"), F.lit(0.0))).alias("symbol_ratio"), (F.col("n_dup_lines") / F.nullif(F.col("n_lines").cast("double"), F.lit(0.0))).alias("dup_line_ratio"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ratios = [c for c in m.columns if c.endswith("_ratio") or c == "mean_word_chars"]
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"), *ratios)
