"""URL filters: base rules by host and path, and association rules mined from labelled URLs.

A URL is a set of tokens: parts of the host with their level from the right, and words of the host and path. Spark's FP-growth mines which token combinations come with which label; rules under the support or confidence
asked for, and rules that a more general one already implies, are pruned. The rules are matched by an inverted index:
the rarest token of a rule leads to it from the URLs that have it, and it fires where they have all of its tokens.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import written

#: host and path prefix, verdict; fixed by the contract
BASE_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path; a null url or one without :// has both empty. Other columns are not looked at."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return (
        pages.select("page_id", "url")
        .withColumn("rest", F.coalesce(rest, F.lit("")))
        .withColumn("path", F.regexp_extract(F.substring(F.col("rest"), F.length(host) + 1, F.length("rest")), r"^[^?#]*", 0))
        .select("page_id", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path")
    )


def base_rule(rules: tuple[tuple[str, str, str], ...] = BASE_RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    fits = lambda host, path: ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered])


def tokens() -> Column:
    """Distinct tokens of host and path; numbers are left out, so they don't name single pages."""
    labels = F.reverse(F.split("host", r"\."))
    levels = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    words = F.transform(F.split("host", r"[.-]"), lambda x: F.concat(F.lit("w="), x))
    steps = F.transform(F.filter(F.split("path", r"[/._-]"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p="), F.lower(x)))
    return F.array_distinct(F.concat(levels, words, steps))


def _set_id() -> Column:
    return F.xxhash64(F.array_join(F.array_sort("tokens"), " "))


def _items(sets: DataFrame, least_rows: float) -> DataFrame:
    """set_id and items: the frequent tokens of each distinct set (set_id, tokens, n rows), one for tokens that always come together.

    Tokens that stand in the very same sets (told by two 64-bit sums of hashes and a count) say the same; the least of them
    speaks for all. A path of 40 fixed words is then one item, and not 2**40 frequent sets.
    """
    each = sets.select("set_id", "n", F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.sum("n").alias("rows"), F.count("*").alias("sets"), *[F.bit_xor(F.xxhash64("set_id", F.lit(k))).alias(f"s{k}") for k in (1, 2)]).where(F.col("rows") >= least_rows)
    kept = seen.groupBy("sets", "s1", "s2").agg(F.min("token").alias("token"))
    return each.join(kept.select("token"), "token", "left_semi").groupBy("set_id").agg(F.collect_list("token").alias("items"))


def mined_rules(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, groups: int = 1, only: str | None = None, enough: int = 10_000) -> DataFrame:
    """Rules (rule_id, items, label, confidence, support) from rows of (tokens, label) and, for groups over 1, group.

    A rule needs `support` of the rows, or `enough` rows where that is less, so that it need not grow with the table for ever; and must
    hold in so many groups: with the confidence asked for among the rows of each on which it fires. It is dropped if a
    rule with fewer of its tokens says the same; tokens that always come together count as the least of them. only: rules of that
    label alone. No labelled rows give no rules.
    """
    label = lambda x: F.concat(F.lit("="), x)
    marked = labelled.withColumn("set_id", _set_id())
    sets = written(marked.groupBy("set_id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")), "url-sets")
    total = sets.agg(F.sum("n").alias("n")).first()["n"] or 0
    share = min(support, enough / total) if total else support
    baskets = marked.join(_items(sets, share * total - 1e-6), "set_id", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(label(F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    said = F.col("consequent")[0]
    rules = rules if only is None else rules.where(said == f"={only}")
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.substring(said, F.lit(2), F.length(said)).alias("label"), "confidence", "support")
    rules = written(rules.withColumn("rule_id", F.xxhash64(F.array_join("items", " "), "label")), "url-rules")
    if groups > 1:
        per_group = marked.groupBy("set_id", "group", F.col("label").alias("told")).agg(F.count("*").alias("rows"))
        per = _fired(sets.select("set_id", "tokens"), rules).select("set_id", "rule_id", "label").join(per_group, "set_id").groupBy("rule_id", "group").agg((F.sum(F.when(F.col("told") == F.col("label"), F.col("rows")).otherwise(0)) / F.sum("rows")).alias("share"))
        rules = written(rules.join(per.where(F.col("share") >= confidence).groupBy("rule_id").count().where(F.col("count") >= groups), "rule_id", "left_semi"), "url-rules-held")
    own = rules.select(F.col("rule_id").alias("set_id"), F.col("items").alias("tokens"), F.col("label").alias("own_label"), F.size("items").alias("length"))
    shorter = _fired(own, rules).where((F.col("label") == F.col("own_label")) & (F.col("needed") < F.col("length")))
    return rules.join(shorter.select(F.col("set_id").alias("rule_id")).distinct(), "rule_id", "left_anti").select("items", "label", "confidence", "support", "rule_id")


def _fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of sets (set_id, tokens, ...) with the rules that fire on them, by an inverted index.

    A rule stands in it under the one of its tokens that the fewest sets have: a token that nearly all sets have, like a
    top-level domain, leads to the rules that have no other.
    """
    each = sets.select(*[c for c in sets.columns], F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    listed = rules.select("rule_id", F.explode("items").alias("token")).join(often, "token")
    key = listed.groupBy("rule_id").agg(F.min_by("token", F.struct("often", "token")).alias("token"))
    index = rules.join(key, "rule_id").select("token", "rule_id", F.col("items").alias("_items"), F.size("items").alias("needed"), "label", "confidence", "support")
    return each.join(index, "token").where(F.size(F.array_intersect("tokens", "_items")) == F.col("needed")).drop("token", "_items")


def verdicts(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """For rows of (page_id, tokens): the label of the firing rule of highest confidence, then support, then lowest id.

    Tokens are looked up in distinct sets of tokens, so a host with a third of all pages costs one lookup for each of
    its distinct sets. A URL on which no rule fires gets the default.
    """
    sets = urls.select("tokens").distinct().withColumn("set_id", _set_id())
    best = _fired(sets, rules).groupBy("set_id").agg(F.max_by("label", F.struct("confidence", "support", -F.col("rule_id").cast("decimal(20,0)"))).alias("mined"))
    return urls.withColumn("set_id", _set_id()).join(best, "set_id", "left").withColumn("mined", F.coalesce("mined", F.lit(default)))


def judged(pages: DataFrame, labels: DataFrame | None = None, support: float = 0.005, confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    labels, if given, are rows of (page_id, label) with label allow or block to mine from. Else every page is an
    example: with the verdict of the base rule that fits it, or allow if none does, so that what base rules say of some
    paths of a domain is not taken for the whole domain; and a rule must hold among the pages of two base rules, else it
    would only say again what one of them says. Only rules that block are mined then: where none fires the verdict is allow. Several labels of one
    page each count as an example.
    """
    parts = written(with_parts(pages).withColumn("base", base_rule()).withColumn("tokens", tokens()), "url-parts")
    if labels is not None:
        rules = mined_rules(parts.join(labels.select("page_id", "label"), "page_id"), support, confidence)
    else:
        rules = mined_rules(parts.select("tokens", F.coalesce("base.verdict", F.lit("allow")).alias("label"), F.coalesce("base.rule", F.lit("")).alias("group")), support, confidence, groups=2, only="block")
    out = verdicts(parts, rules)
    return out.select("page_id", "host", "path", F.col("base.rule").alias("rule"), F.coalesce("base.verdict", "mined").alias("verdict"))


def held_out_counts(pages: DataFrame, support: float = 0.005, confidence: float = 0.9) -> DataFrame:
    """(label, mined, pages): what rules mined on the pages of one half of the hosts say of the other half's.

    Only pages that a base rule judges take part, and its verdict is their label; `none` where no rule fires.
    """
    parts = written(with_parts(pages).withColumn("label", base_rule()["verdict"]).where("label is not null").withColumn("tokens", tokens()), "url-halves")
    half = F.pmod(F.xxhash64("host"), F.lit(2))
    rules = mined_rules(parts.where(half == 0), support, confidence)
    told = verdicts(parts.where(half == 1), rules, "none")
    return told.groupBy("label", "mined").agg(F.count("*").alias("pages"))
