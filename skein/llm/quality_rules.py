"""Quality rules with risk-controlled thresholds.

Each rule compares a statistic of a document with a cutoff. Cutoffs are chosen on labelled documents: for each stratum
(language), rule and cutoff of a fixed grid, the exact binomial tail P(Bin(n, risk) <= k) tests whether the rule rejects more
than `risk` of the good documents, of which it rejected k of n. With a Bonferroni correction over all tests of the grid, the
chance that any chosen cutoff exceeds its risk is below `delta`. Of the cutoffs that pass, a rule takes the one that rejects
most bad documents (ties: the most lenient); strata with too few labels take no cutoff and reject nothing.

Everything is DataFrame functions; the chosen cutoffs (strata x rules rows) join back by broadcast only below a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, cut, let, table, words

SYMBOLS = "#*$%&|<>"
RISK, DELTA = 0.02, 0.05
#: Rule, statistic, and its grid of cutoffs from lenient to strict; a document fails where the statistic is above.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("1.0 * n_symbols / n_words", [1.0, 0.5, 0.3, 0.2, 0.1, 0.05]),
    "dup_lines": ("1.0 * n_dup_lines / n_lines", [0.6, 0.45, 0.3, 0.2, 0.1]),
    "repeats": ("1.0 * n_repeat_words / n_words", [0.4, 0.3, 0.2, 0.1, 0.05]),
    "capitals": ("1.0 * n_capitals / word_chars", [0.9, 0.7, 0.5, 0.3]),
    "long_words": ("1.0 * word_chars / n_words", [30.0, 20.0, 15.0, 12.0, 10.0]),
    "short_words": ("-1.0 * word_chars / n_words", [-1.5, -2.0, -2.5, -3.0]),
    "marks": ("1.0 * n_marks / n_words", [1.0, 0.6, 0.4, 0.2]),
}


def _repeat_words(ws: Column) -> Column:
    """Words within 3-word windows that a text has twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.cast("int").alias("p")))
    # Sorted by hash, a repeated window has an equal neighbour.
    def repeated(a: Column) -> Column:
        at = F.filter(a, lambda x, k: (F.get(a, k - 1)["h"] == x["h"]) | (F.get(a, k + 1)["h"] == x["h"]))
        return F.array_sort(F.transform(at, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")))["n"]

    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(ws) < 4, F.lit(0)).when(~some, F.lit(0)).otherwise(let(let(F.array_sort(windows), repeated), covered)).cast("long")


def document_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds a struct column `stats` of counts over the whole text; null and blank texts count as without words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def without(signs: str) -> Column:
        """The text without some ASCII signs, one search a sign: far cheaper than translate, which looks up each character."""
        out = text
        for c in signs:
            out = F.replace(out, F.lit(c), F.lit(""))
        return out

    def number(signs: str) -> Column:
        return (F.length(text) - F.length(without(signs))).cast("long")

    def counts(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(without(SPACES)).cast("long").alias("word_chars"),
            number(SYMBOLS).alias("n_symbols"),
            let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
            _repeat_words(ws).alias("n_repeat_words"),
            F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
            number("!?").alias("n_marks"),
        )

    return docs.withColumn("stats", let(words(text), counts))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly in logarithms term by term."""
    odds = F.log(F.lit(p / (1 - p)))
    first = F.struct((n * F.log(F.lit(1 - p))).cast("double").alias("term"), F.exp(n * F.log(F.lit(1 - p))).cast("double").alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + odds
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    return F.when(k <= 0, F.exp(n * F.log(F.lit(1 - p)))).when(k >= n, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1).cast("long"))), first, step)["sum"])


def choose_cutoffs(labelled: DataFrame, rules=RULES, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """From rows (stratum, good boolean, and one column a rule) the columns stratum, rule, cutoff, n, k, tail.

    The number of tests that the correction counts is strata x all cutoffs of the grid. No labels give no cutoffs.
    """
    grid = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cutoff"), (F.coalesce(F.col(f"`{rule}`"), F.lit(float("-inf"))) > c).alias("fails")) for rule, (_, cuts) in rules.items() for i, c in enumerate(cuts)])
    counted = (
        labelled.select("stratum", "good", F.explode(grid).alias("g")).groupBy("stratum", "g.rule", "g.i", "g.cutoff")
        .agg(F.sum(F.col("good").cast("long")).alias("n"), F.sum((F.col("good") & F.col("g.fails")).cast("long")).alias("k"), F.sum((~F.col("good") & F.col("g.fails")).cast("long")).alias("caught"))
    )
    tests = counted.agg(F.count("*").alias("tests"))
    passed = counted.crossJoin(F.broadcast(tests)).withColumn("tail", binomial_tail(F.col("k"), F.col("n"), risk)).filter(F.col("tail") * F.col("tests") <= delta).filter("caught > 0")
    return passed.groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "n", "k", "tail"), F.struct("caught", (-F.col("i")).alias("o"))).alias("c")).select("stratum", "rule", "c.*")


def apply_quality_rules(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the rules that rejected the document (failed_rules).

    Null languages form a stratum of their own. A document labelled more than once counts once for each label; labels with a
    null doc_id or quality, or without a document, take no part. Empty texts have no words and fail the base rule.
    """
    flat = document_statistics(docs.select("doc_id", "text", F.coalesce(F.col(stratum_col), F.lit("")).alias("stratum")))
    flat = flat.select("doc_id", "stratum", "stats.n_words", "stats.word_chars", "stats.n_symbols", F.col("stats.lines.dup").alias("n_dup_lines"), F.greatest(F.col("stats.lines.n"), F.lit(1)).alias("n_lines"), "stats.n_repeat_words", "stats.n_capitals", "stats.n_marks")
    flat = flat.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    for rule, (statistic, _) in rules.items():
        flat = flat.withColumn(rule, F.when(F.col("n_words") > 0, F.expr(statistic)).cast("double"))
    flat = cut(flat)  # the statistics are read twice: for the labelled documents, and for all
    marked = labels.filter("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 1).alias("good"))
    chosen = choose_cutoffs(flat.filter("not base_failed").join(marked, "doc_id"), rules, risk, delta)
    # One row a stratum, with a map from rule to cutoff: as many rows as there are strata.
    by_stratum = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    joined = flat.join(by_stratum, "stratum", "left")
    failed = F.filter(F.array(*[F.when(F.col(f"`{r}`") > F.col("cutoffs")[r], F.lit(r)) for r in rules]), lambda x: x.isNotNull())
    return joined.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLES: dict[str, str] = {}
