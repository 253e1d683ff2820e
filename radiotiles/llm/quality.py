"""Quality rules: a learned decision list over text statistics, in DataFrame functions only.

`statistics` computes the numbers of each text inside its own row, so nothing is shuffled.  `learn`
grows rules by sequential covering: a rule starts empty and takes the threshold condition with the
best gain until it covers no clean grow row or nothing helps; conditions are then pruned from the
end on rows held back for that; rows it covers go, and the next rule is grown.  Each step is one
aggregation of the labelled statistics by feature and bin, so only (features x bins) counts reach
the driver.  `verdict` turns the rules into one ordered CASE expression.

Empty table: no rows; without labels or without bad labels there are no rules and the verdict is the
base's.  Null text: no words, so every number is 0 and the base fails.  Null labels do not train; a
repeated label row counts twice.  Null ids are scored but never trained on.  Other columns are
ignored.  Windows of three words are compared by a 64-bit hash within their own text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiotiles.llm.common import SPACES, stage

SYMBOLS = "#*$%&|<>"
#: What the rules may test; each is a number of one text.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "word_length": "try_divide(word_chars, n_words)",
    "symbol_share": "try_divide(n_symbols, word_chars)",
    "dup_line_share": "try_divide(n_dup_lines, n_lines)",
    "repeat_share": "try_divide(n_repeat_words, n_words)",
    "capital_share": "try_divide(n_capital_words, n_words)",
    "bang_share": "try_divide(n_bangs, n_words)",
    "distinct_share": "try_divide(n_distinct_words, n_words)",
    "digit_share": "try_divide(n_digits, word_chars)",
    "words_per_line": "try_divide(n_words, n_lines)",
}


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("t"),
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != "").alias("lines"),
    )
    windows = words.withColumn("h", F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), 1, F.greatest(F.size("w") - 2, F.lit(0))))
    ordered = windows.withColumn(
        "s",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    repeated = F.filter("s", lambda s, k: (s["h"] == F.get("s", k - 1)["h"]) | (s["h"] == F.get("s", k + 1)["h"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda s: F.array(s["i"], s["i"] + 1, s["i"] + 2)))))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    return ordered.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(without(F.col("t"), SPACES)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda w: (w == F.upper(w)) & (w != F.lower(w)))).cast("long").alias("n_capital_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        (F.length("t") - F.length(without(F.col("t"), "!"))).cast("long").alias("n_bangs"),
        count("[0-9]").cast("long").alias("n_digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"`{self.feature}`")
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return F.coalesce(out, F.lit(False))


def features() -> list[Column]:
    return [F.coalesce(F.expr(e), F.lit(0.0)).alias(k) for k, e in FEATURES.items()]


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of going from (p0 bad, n0 clean) rows to (p, n)."""
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(labelled: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Rules for the bad rows of `labelled` (the statistics, doc_id and quality 0/1)."""
    rows = stage(
        labelled.where("quality is not null").select((F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).alias("held"), *features()),
        "labelled",
    )
    names = list(FEATURES)
    cuts = rows.agg(*[F.percentile_approx(k, [i / bins for i in range(1, bins)], 2000).alias(k) for k in names]).first()
    thresholds = {k: sorted(set(cuts[k] or [])) for k in names}
    bin_of = {k: sum((F.when(F.col(k) > t, 1).otherwise(0) for t in thresholds[k]), F.lit(0)) for k in names}
    binned = stage(rows.select("bad", "held", *names, F.array(*[F.struct(F.lit(k).alias("f"), bin_of[k].alias("b")) for k in names]).alias("bins")), "binned")
    rules: list[Rule] = []
    free = F.lit(True)
    for _ in range(max_rules):
        conditions: list[Condition] = []
        inside, held = binned.where(free & ~F.col("held")), binned.where(free & F.col("held"))
        p0 = n0 = None
        while len(conditions) < max_conditions:
            table = inside.where(Rule(tuple(conditions)).column()).select("bad", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(F.sum(F.col("bad").cast("int")).alias("p"), F.count("*").alias("m")).collect()
            counts: dict[str, dict[int, tuple[int, int]]] = {k: {} for k in names}
            for r in table:
                counts[r["f"]][r["b"]] = (r["p"], r["m"] - r["p"])
            p0, n0 = (sum(v[i] for v in counts[names[0]].values()) for i in (0, 1))
            if p0 < least or (conditions and not n0):
                break
            best, found = 0.0, None
            for k in names:
                low = [0, 0]
                for b, t in enumerate(thresholds[k]):
                    p, n = counts[k].get(b, (0, 0))
                    low[0] += p
                    low[1] += n
                    for above, (p, n) in ((False, low), (True, (p0 - low[0], n0 - low[1]))):
                        if p >= least and (g := gain(p, n, p0, n0)) > best + 1e-9:
                            best, found = g, Condition(k, above, t)
            if not found:
                break
            conditions.append(found)
        if not conditions:
            break
        # prune from the end: the shortest rule with the best (p - n) / (p + n) on the rows held back
        cover = [Rule(tuple(conditions[: k + 1])).column() for k in range(len(conditions))]
        seen = held.agg(*[F.count_if(c & (F.col("bad") == bad)).alias(f"{i}_{bad}") for i, c in enumerate(cover) for bad in (True, False)]).first()
        worth = [(seen[f"{i}_True"], seen[f"{i}_False"]) for i in range(len(cover))]
        k = max(range(len(cover)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(1, sum(worth[i])), worth[i][0], -i))
        rule, (p, n) = Rule(tuple(conditions[: k + 1])), worth[k]
        if (p + 1) / (p + n + 2) < precision or p < 2:
            break
        rules.append(rule)
        free = free & ~rule.column()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True (keep) unless a rule fires; the first that does decides."""
    out = F
    for r in rules:
        out = out.when(r.column(), F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def rule_number(rules: list[Rule]) -> Column:
    """Which rule decided, from 1; 0 for none."""
    out = F
    for i, r in enumerate(rules):
        out = out.when(r.column(), F.lit(i + 1))
    return F.lit(0) if out is F else out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The statistics of every document with base_failed, rule (which one rejects it, 0: none) and kept."""
    stats = stage(statistics(docs), "statistics")
    own = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("quality").cast("int").alias("quality")).where("i is not null")
    rules = learn(stats.join(own, F.col("doc_id") == F.col("i")).drop("i"), **how)
    numbers = stats.columns
    scored = stats.select(F.struct(*numbers).alias("numbers"), *features())
    judged = scored.select("numbers.*", rule_number(rules).alias("rule"))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
