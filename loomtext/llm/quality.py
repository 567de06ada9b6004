"""Quality rules: statistics of whole texts, and decision lists learnt from labelled ones.

Sequential covering: a rule is a conjunction of thresholds, grown on two thirds of the labelled rows by FOIL gain and
pruned on the other third; rows it covers leave, and the next rule is grown. The ordered rules become one Spark
conditional expression. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import own_id, written

WINDOW = 8
FEATURES = ("n_words", "mean_word", "symbol_share", "upper_share", "mark_share", "dup_line_share", "repeat_share", "line_words")


def stats(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and counts for the features.

    Words are runs of characters other than space, tab and the controls up to CR. A null or empty text has none and
    all counts 0. Repeated rows each give a row; columns other than doc_id and text are not looked at, those named in
    `more` are handed on.
    Repeated 8-word windows are found inside the row: 64-bit hashes of windows, made of the hashes of their words, are
    sorted with their positions, and those equal to a neighbour's are repeated.
    """
    kept = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    worded = (
        docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .select(
            "doc_id",
            *more,
            "words",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            kept(r"[^#*$%&|<>]+").alias("n_symbols"),
            kept(r"[^A-Z]+").alias("n_upper"),
            kept(r"[^!?]+").alias("n_marks"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        )
        .withColumn("words", F.when(F.col("n_words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w))))
        .withColumn("grams", F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])))
        .drop("words")
    )
    some = worded.withColumn("grams", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.col("grams")))
    placed = some.withColumn("placed", F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))).drop("grams")
    same = lambda x, j: F.coalesce(F.get("placed", j)["h"] == x["h"], F.lit(False))
    again = F.filter("placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    sure = placed.withColumn("at", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("placed")
    steps = F.transform("at", lambda p, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(WINDOW).cast("long"))))
    return sure.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("at")


def with_features(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0).cast("long")), F.lit(0.0))
    return (
        counts.withColumn("mean_word", share("word_chars", "n_words"))
        .withColumn("symbol_share", share("n_symbols", "n_words"))
        .withColumn("upper_share", share("n_upper", "word_chars"))
        .withColumn("mark_share", share("n_marks", "n_words"))
        .withColumn("dup_line_share", share("n_dup_lines", "n_lines"))
        .withColumn("repeat_share", share("n_repeat_words", "n_words"))
        .withColumn("line_words", share("n_words", "n_lines"))
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) < self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out


def _grown(rows: DataFrame, edges: dict[str, list[float]], longest: int) -> tuple[Condition, ...]:
    """Conditions added one by one; each step counts bad and good rows by feature and bin, a few hundred numbers."""
    above = lambda f: sum(((F.col(f) >= t).cast("int") for t in edges[f]), F.lit(0))
    bins = F.array(*[F.struct(F.lit(f).alias("f"), above(f).alias("bin")) for f in edges])
    chosen: tuple[Condition, ...] = ()
    while len(chosen) < longest:
        counted = rows.where(Rule(chosen).column()).select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
        by = {f: [(0, 0)] * (len(e) + 1) for f, e in edges.items()}
        for r in counted:
            by[r["f"]][r["bin"]] = (r["bad"], r["n"] - r["bad"])
        first = next(iter(by.values()))
        bad, good = (sum(x[i] for x in first) for i in (0, 1))
        if not bad or not good:
            break
        best = None
        for f, e in edges.items():
            for k, t in enumerate(e):
                for at_least, part in ((True, by[f][k + 1 :]), (False, by[f][: k + 1])):
                    p, n = sum(x[0] for x in part), sum(x[1] for x in part)
                    gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good))) if p else 0.0
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, Condition(f, at_least, t))
        if best is None:
            break
        chosen = (*chosen, best[1])
    return chosen


def _pruned(rows: DataFrame, grown: tuple[Condition, ...]) -> tuple[tuple[Condition, ...], int, int]:
    """The start of the conjunction with the best (bad - good) / all on held-back rows, and its counts there."""
    count = [F.sum(F.when(Rule(grown[: k + 1]).column(), x).otherwise(0)).alias(f"{n}{k}") for k in range(len(grown)) for n, x in (("bad", F.col("bad")), ("good", 1 - F.col("bad")))]
    got = rows.agg(*count).first()
    best = max(range(len(grown)), key=lambda k: ((got[f"bad{k}"] or 0) - (got[f"good{k}"] or 0)) / max(1, (got[f"bad{k}"] or 0) + (got[f"good{k}"] or 0)))
    return grown[: best + 1], got[f"bad{best}"] or 0, got[f"good{best}"] or 0


def learnt(labelled: DataFrame, most_rules: int = 6, longest: int = 3, precision: float = 0.9, least_bad: int = 2) -> list[Rule]:
    """Ordered rules that reject, from rows of the features and bad (1: low quality).

    A rule stays if, on the held-back third, at least `precision` of what it covers is bad and it covers `least_bad`
    bad rows. No labelled rows, or none that are bad, give no rules.
    """
    rows = written(labelled.withColumn("grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) > 0), "quality-labelled")
    cuts = rows.agg(*[F.percentile(F.col(f).cast("double"), [k / 20 for k in range(1, 20)]).alias(f) for f in FEATURES], *[F.min(f).alias(f"least_{f}") for f in FEATURES]).first()
    edges = {f: sorted({x for x in cuts[f] or [] if x > cuts[f"least_{f}"]}) for f in FEATURES}
    edges = {f: e for f, e in edges.items() if e}
    rules: list[Rule] = []
    while edges and len(rules) < most_rules:
        grown = _grown(rows.where("grow"), edges, longest)
        if not grown:
            break
        kept, bad, good = _pruned(rows.where("not grow"), grown)
        if bad < least_bad or bad < precision * (bad + good):
            break
        rules.append(Rule(kept))
        rows = rows.where(~rules[-1].column())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """true where no rule rejects: the ordered list as one conditional expression."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def learnt_from(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, **how) -> list[Rule]:
    """Rules from at most most_labelled labelled documents, those of the least hash of doc_id; all labelled rows up to
    that bound, so the list of ids that is broadcast has that bound too. Labels with a null are not used; of several of
    one document the lowest quality counts."""
    some = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    own = with_features(stats(own_id(docs).join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")))
    return learnt(own.join(F.broadcast(some), "doc_id").select("doc_id", *FEATURES, (1 - F.col("quality")).alias("bad")), **how)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats() with base_failed and kept."""
    return with_features(stats(docs)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def filtered(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents that judged() keeps, all columns and repeated rows as they were."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    judged_ = with_features(stats(whole, ("whole",))).select("whole", (~base_failed() & verdict(rules)).alias("kept"))
    # The row number keeps Spark from evaluating the statistics again inside the filter.
    return judged_.withColumn("row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("row") >= 0)).select("whole.*")
