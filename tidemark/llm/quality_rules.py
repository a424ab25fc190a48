"""Risk-controlled quality rules, in DataFrame expressions only.

Every document gets text statistics.  A policy rejects by one or more rules at once, each a statistic, a direction and a
cutoff.  Chains of policies are fixed in advance, each from lax to strict: all rules together, all but one, and each rule
alone.  Labelled documents are a holdout: nothing is fitted on them but which policy is taken.  Per stratum (the value of
`lang`), the hypothesis "this policy rejects more than alpha of the good documents" is tested by the exact binomial tail
of the good labelled documents that it rejects, by whichever rule, so that alpha is one budget for all rules.  Policies
are tested in the order of their chain until one fails (fixed sequence, which costs no correction), and the level is
divided by strata x chains (Bonferroni), so with probability 1 - delta no policy is proved in any stratum that loses more
than alpha of its good documents.  Of the proved ones any may be taken: it is the one that rejects the most labelled bad
documents, then the fewest good ones, then the first.  A stratum without a proved policy keeps what passes the base rule.

Edge cases: null text counts as no words and fails the base rule; null `lang` is a stratum of its own, apart from ''; repeated labels
of a document count once, as good only if all of them are; documents without a label are judged like the others; an
empty table gives an empty result; unrelated columns are ignored.  Work on a text is n log n in its words.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import SPACE, small, stored


@dataclass(frozen=True)
class Rule:
    """Rejects where value > cutoff (above) or value < cutoff; value is SQL over the statistics, with integers only.  Cutoffs go from lax to strict, one for each level of a chain."""

    name: str
    left: str
    right: str
    above: bool
    cutoffs: Sequence[int]

    def rejects(self, cutoff: Column) -> Column:
        a, b = F.expr(self.left), F.expr(self.right) * cutoff
        return a > b if self.above else a < b


#: Ratios are compared as left against cutoff * right, so no division is done.
RULES = (
    Rule("symbols", "100 * n_symbols", "n_words", True, (200, 100, 80, 60, 40, 30, 20, 15, 10)),
    Rule("repeats", "100 * n_repeat_words", "n_words", True, (45, 40, 40, 35, 35, 30, 30, 25, 20)),
    Rule("dup_lines", "n_dup_lines", "CAST(1 AS BIGINT)", True, (100, 50, 20, 15, 10, 7, 5, 3, 2)),
    Rule("long_words", "10 * word_chars", "n_words", True, (200, 150, 140, 130, 120, 110, 100, 90, 80)),
)


def chains(rules: Sequence[Rule] = RULES) -> list[tuple[Rule, ...]]:
    """All rules, all but one, one."""
    some = [tuple(rules), *[tuple(r for r in rules if r is not x) for x in rules], *[(r,) for r in rules]]
    return [c for k, c in enumerate(some) if c and c not in some[:k]]


def policies(rules: Sequence[Rule] = RULES) -> list[tuple[int, int, dict[str, int]]]:
    """(chain, level, cutoff by rule)."""
    return [(k, j, {r.name: r.cutoffs[j] for r in chain}) for k, chain in enumerate(chains(rules)) for j in range(len(rules[0].cutoffs))]


ALPHA, DELTA = 0.05, 0.05


def statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id", "lang")) -> DataFrame:
    """keep, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, t.alias("__t"))
    df = df.withColumn("__w", F.filter(F.split("__t", SPACE), lambda w: w != ""))
    df = df.withColumn("__n", F.size("__w").cast("long"))
    # Each window of three words, under a hash that is quick to sort by; arrays of one row are kept as columns, so each is made once.
    m = F.greatest(F.lit(0), F.size("__w") - 2)
    two = F.zip_with(F.slice("__w", F.lit(1), m), F.slice("__w", F.lit(2), m), lambda a, b: F.concat_ws(" ", a, b))
    df = df.withColumn("__h", F.when(F.col("__n") >= 3, F.zip_with(two, F.slice("__w", F.lit(3), m), lambda p, c: F.concat_ws(" ", p, c))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__s", F.sort_array(F.transform("__h", lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("x"), i.alias("i")))))
    m = F.size("__s")
    df = df.withColumn("__e", F.when(m >= 2, F.zip_with(F.slice("__s", F.lit(1), F.greatest(F.lit(0), m - 1)), F.slice("__s", F.lit(2), F.greatest(F.lit(0), m - 1)), lambda a, b: (a["h"] == b["h"]) & (a["x"] == b["x"]))).otherwise(F.array().cast("array<boolean>")))
    df = df.withColumn(
        "__p",
        F.when(
            F.exists("__e", lambda x: x),
            F.sort_array(
                F.filter(
                    F.zip_with(
                        F.col("__s"),
                        F.zip_with(F.concat(F.array(F.lit(False)), F.col("__e")), F.concat(F.col("__e"), F.array(F.lit(False))), lambda a, b: a | b),
                        lambda s, d: F.when(d, s["i"]),
                    ),
                    lambda x: x.isNotNull(),
                )
            ),
        ).otherwise(F.array().cast("array<int>")),
    )
    k = F.size("__p")
    # A window found again covers three words, less where the next such window begins sooner.
    gaps = F.zip_with(F.col("__p"), F.concat(F.slice("__p", F.lit(2), F.greatest(F.lit(0), k - 1)), F.array(F.lit(2**31 - 1))), lambda a, b: F.least(F.lit(3), b - a))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__l", lines)
    return df.select(
        *keep,
        F.col("__n").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(k == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(0), lambda a, x: a + x)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _ln_factorial(n: Column) -> Column:
    """Exact below 16, by Stirling's series (relative error under 1e-15) from there."""
    x = n.cast("double")
    y = F.greatest(x, F.lit(16.0))
    series = y * F.ln(y) - y + F.lit(0.5) * F.ln(F.lit(6.283185307179586) * y) + F.lit(1.0) / (y * 12) - F.lit(1.0) / (y * y * y * 360) + F.lit(1.0) / (y * y * y * y * y * 1260)
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(15), n.cast("int")))), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    return F.when(x >= 16, series).when(x <= 1, F.lit(0.0)).otherwise(small)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k); 1 where k is at least the mean, as no test is passed there."""
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.lit(0.0),
        lambda a, i: a + F.exp(_ln_factorial(n) - _ln_factorial(i) - _ln_factorial(n - i) + i * F.ln(F.lit(p)) + (n - i) * F.ln(F.lit(1.0 - p))),
    )
    return F.when((n == 0) | (k >= n * F.lit(p)), F.lit(1.0)).otherwise(total)


def _rejected(cutoffs: dict[str, Column], rules: Sequence[Rule]) -> Column:
    """Whether a rule with a cutoff rejects; a null cutoff rejects nothing."""
    out = F.lit(False)
    for r in rules:
        if r.name in cutoffs:
            out = out | F.coalesce(r.rejects(cutoffs[r.name]), F.lit(False))
    return out


def calibrated(stats: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a proved policy: lang, n_good, chain, level, and the cutoff of each rule (cut_<rule>; null: not in it)."""
    quality = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__q"))
    known = stats.join(quality, "doc_id").where(~base_failed())
    plans = policies(rules)
    hit = [_rejected({n: F.lit(c) for n, c in cuts.items()}, rules) for _, _, cuts in plans]
    good, bad = F.col("__q") == 1, F.col("__q") == 0
    counts = known.groupBy("lang").agg(
        F.count_if(good).alias("n"), *[F.count_if(good & h).alias(f"k{i}") for i, h in enumerate(hit)], *[F.count_if(bad & h).alias(f"b{i}") for i, h in enumerate(hit)]
    )
    counts = stored(counts.where("n > 0"), "quality-counts")
    tests = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("chain"), F.lit(j).alias("level"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("b"), *[F.lit(cuts.get(r.name)).cast("long").alias(f"cut_{r.name}") for r in rules])
                for i, (c, j, cuts) in enumerate(plans)
            ]
        )
    )
    rows = counts.select("lang", "n", tests.alias("t")).select("lang", "n", "t.*").withColumn("p", binomial_tail(F.col("k"), F.col("n"), alpha))
    in_order = Window.partitionBy("lang", "chain").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    proved = rows.withColumn("worst", F.max("p").over(in_order)).where(F.col("worst") * F.lit(counts.count() * len(chains(rules))) <= F.lit(delta))
    names = ["chain", "level", *[f"cut_{r.name}" for r in rules]]
    best = F.max_by(F.struct("n", *names), F.struct("b", -F.col("k"), -F.col("chain"), -F.col("level")))
    return proved.groupBy("lang").agg(best.alias("best")).select("lang", F.col("best.n").alias("n_good"), *[f"best.{n}" for n in names])


def judge(docs: DataFrame, labels: DataFrame, rules: Sequence[Rule] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """statistics(), base_failed, kept, stratum and policy (the rules and cutoffs of its stratum; null: none proved) of each row of docs (doc_id, text, lang)."""
    stats = stored(statistics(docs), "quality-statistics")
    cuts = stored(calibrated(stats, labels, rules, alpha, delta), "quality-cutoffs").withColumnRenamed("lang", "__lang")
    df = stats.join(small(cuts, 128), F.col("lang").eqNullSafe(F.col("__lang")), "left")
    policy = F.concat_ws(", ", *[F.when(F.col(f"cut_{r.name}").isNotNull(), F.concat(F.lit(f"{r.name} {'>' if r.above else '<'} "), F.col(f"cut_{r.name}").cast("string"))) for r in rules])
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & ~_rejected({r.name: F.col(f"cut_{r.name}") for r in rules}, rules)).alias("kept"),
        F.col("lang").alias("stratum"), F.when(F.col("chain").isNotNull(), policy).alias("policy"),
    )
