"""Quality rules: learned decision lists.

Statistics of a document are Spark expressions. From labelled documents a list of rules is learned by
sequential covering: a rule grows by the threshold condition with the largest information gain on the growing part, until none
helps; it is pruned to the prefix with the best (p - n) / (p + n) on the other part, and accepted when its precision there
is ``precision`` or more. Documents it covers are taken away and the next is learned. Each step is one aggregation: counts of both
labels by statistic and quantile bin come back, never documents. The list is applied as one ordered
conditional expression: the first rule that holds rejects.

Everything is a DataFrame expression; a document's statistics are computed in its own row, without a shuffle.

Defined results: a null or empty text has no words and fails the base rule; without labels, or with one label only, the
list is empty and the base rule decides; a label given more than once counts once if it's the same and not at all if
labels differ; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import WHITE, maybe_in
from panelspark.session import materialize

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Statistics that conditions may use, from the counts of a document.
RATIOS = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.name) >= self.value if self.above else F.col(self.name) < self.value


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for the row, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def window_hashes(words: Column) -> Column:
    """A hash of every window of three words."""
    at = F.sequence(F.lit(1), F.size(words) - 2)
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        at, lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))))


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words in windows of three that stand twice or more in the array; windows with equal hashes are compared."""
    def same(x: Column, y: Column) -> Column:
        a, b = x["i"], y["i"]
        return (x["h"] == y["h"]) & (F.get(words, a) == F.get(words, b)) & (
            F.get(words, a + 1) == F.get(words, b + 1)) & (F.get(words, a + 2) == F.get(words, b + 2))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | same(x, F.get(s, k - 1)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
                           F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i"))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
        bind(F.array_sort(placed), lambda s: bind(starts(s), covered)))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """doc_id, the base counts, the counts behind RATIOS, and RATIOS; ``with_row`` adds the input row as __row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, f"[{WHITE}]+"), "")
    row = [F.struct(*docs.columns).alias("__row")] if with_row else []
    cut = docs.select(F.col(id_col).alias("doc_id"), text.alias("__text"), words.alias("__words"), *row)
    cut = cut.withColumn("__hashes", window_hashes(F.col("__words")))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(f"[^{WHITE}]"))
    counts = cut.select(
        "doc_id", *["__row"] * with_row, F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("__lines"),
        repeated_words(F.col("__words"), F.col("__hashes")).alias("n_repeat_words"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", "[!?]+", ""))).cast("long").alias("n_marks"))
    named = counts.select("*", (F.col("__lines.n") - F.col("__lines.d")).cast("long").alias("n_dup_lines"),
                          F.col("__lines.n").cast("long").alias("n_lines")).drop("__lines")
    return named.select("doc_id", *["__row"] * with_row, *BASE, "n_lines", "n_upper", "n_marks",
                        *[F.expr(e).cast("double").alias(n) for n, e in RATIOS.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def label_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``stats``, a written table: labelled documents that pass the base rule, with bad (1 to be rejected) and grow (part to grow on)."""
    one = labels.groupBy(F.col("doc_id").alias("l_id")).agg(
        F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    return (stats.where(~base_failed()).join(one, F.col("doc_id") == F.col("l_id"))
            .select(*RATIOS, (1 - F.col("q")).cast("long").alias("bad"),
                    (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grow")))


def bin_of(name: str, cuts: list[float]) -> Column:
    """How many of ``cuts`` the statistic reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= F.col(name)))


STEP = 200  # bins of log(1 + statistic) in a unit


def thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Cuts at quantiles of either label, from counts on a fixed logarithmic grid: a few thousand numbers whatever
    the input, and the same in every run."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.floor(F.log1p(n) * STEP).alias("at")) for n in RATIOS]))
    counted = rows.select("bad", each.alias("x")).groupBy("x.name", "bad", "x.at").agg(F.count("*").alias("n")).collect()
    cuts: dict[str, set[float]] = {n: set() for n in RATIOS}
    for name in RATIOS:
        for side in (0, 1):
            own = sorted((r["at"], r["n"]) for r in counted if r["name"] == name and r["bad"] == side)
            total, seen, mark = sum(n for _, n in own), 0, 1
            for at, n in own:
                seen += n
                if seen * bins >= mark * total:
                    cuts[name].update((math.expm1(at / STEP), math.expm1((at + 1) / STEP)))
                    mark = seen * bins // total + 1
    return {n: sorted(c) for n, c in cuts.items()}


def gain(p: int, n: int, p0: int, n0: int) -> float:
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn(rows: DataFrame, bins: int = 64, most_rules: int = 8, most_conditions: int = 4, precision: float = 0.9,
          least: int = 20) -> list[list[Condition]]:
    """The decision list: rules in order, each a list of conditions."""
    rows = materialize(rows)
    size = rows.agg(F.count("*").alias("n"), F.sum("bad").alias("p")).first()
    if not size["n"] or not size["p"] or size["p"] == size["n"]:
        return []
    cuts = thresholds(rows, bins)
    binned = materialize(rows.select("bad", "grow", *RATIOS, *[bin_of(n, cuts[n]).alias(f"bin_{n}") for n in RATIOS]))

    def counts(part: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"bin_{n}").alias("bin")) for n in RATIOS]))
        table = part.select("bad", each.alias("x")).groupBy("x.name", "x.bin").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        out: dict[str, dict[int, tuple[int, int]]] = {}
        for r in table:
            out.setdefault(r["name"], {})[r["bin"]] = (r["p"], r["n"])
        return out

    def best_condition(found, p0: int, n0: int) -> tuple[float, Condition | None]:
        top = (0.0, None)
        for name in RATIOS:
            p = n = 0
            by_bin = found.get(name, {})
            for k, cut in enumerate(cuts[name]):
                a, b = by_bin.get(k, (0, 0))
                p, n = p + a, n + b  # below the cut
                for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                    if x >= least and (g := gain(x, y, p0, n0)) > top[0] + 1e-9:
                        top = (g, Condition(name, above, float(cut)))
        return top

    def all_of(rule: list[Condition]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & c.column()
        return out

    rules: list[list[Condition]] = []
    left = binned
    for _ in range(most_rules):
        rule: list[Condition] = []
        while len(rule) < most_conditions:
            found = counts(left.where(F.col("grow")).where(all_of(rule)))
            some = next(iter(found.values()), {})
            p0, n0 = sum(p for p, _ in some.values()), sum(n for _, n in some.values())
            if p0 < least or not n0:
                break
            condition = best_condition(found, p0, n0)[1]
            if condition is None or condition in rule:
                break
            rule.append(condition)
        if not rule:
            break
        tests = left.where(~F.col("grow")).agg(*[F.sum(F.when(all_of(rule[:k]), b)).alias(f"{s}{k}")
                                                 for k in range(1, len(rule) + 1)
                                                 for s, b in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        scored = [((tests[f"p{k}"] or 0), (tests[f"n{k}"] or 0), k) for k in range(1, len(rule) + 1)]
        p, n, k = max(scored, key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), -x[2]))
        if p + n == 0 or p / (p + n) < precision:
            break
        rules.append(rule[:k])
        left = left.where(~all_of(rule[:k]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, 0 for none."""
    out = F.when(F.lit(False), 0)
    for k, rule in enumerate(rules, 1):
        held = F.lit(True)
        for c in rule:
            held = held & c.column()
        out = out.when(held, k)
    return out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, rule (its number, 0 for none) and kept."""
    stats = materialize(statistics(docs, id_col, text_col))
    rules = learn(label_rows(stats, labels), **options)
    return (stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule"))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
            .select("doc_id", *BASE, "base_failed", "rule", "kept"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs that the base rule and the learned list keep; columns stay as they are.

    The list is learned from the statistics of labelled documents, the only ones written; then all are judged where they are read.
    """
    known = maybe_in(docs, F.col(id_col).cast("long"), labels.select(F.col("doc_id").cast("long").alias("l")), "l")
    rules = learn(label_rows(materialize(statistics(known, id_col, text_col)), labels), **options)
    rows = statistics(docs, id_col, text_col, with_row=True)
    # Exploded, so that the filter does not move below the statistics and repeat them.
    once = F.explode(F.array(F.struct(*[c for c in rows.columns if c != "__row"]))).alias("s")
    return rows.select("__row", once).select("__row", "s.*").where(~base_failed() & (verdict(rules) == 0)).select("__row.*")
