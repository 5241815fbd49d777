"""Mixing sources to target weights: budgets down a tree of domains, languages and sources, then token prefixes of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import discard, fresh, materialize, small

LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of an epoch's order by which buckets are parted, and how often: 256 buckets of a leaf, of its last bucket, and of that one's last.
DIGITS, DEPTH = 2, 3
DOMAINS = ("web", "forum", "reference", "books")


def domain_of(source: Column, domains: tuple[str, ...] = DOMAINS) -> Column:
    """A stand-in for a table of domains: the number at the end of a source's name, modulo the domains; without a number, the first."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1), F.lit("999999999")).cast("long"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, domains)), (F.pmod(number, F.lit(len(domains))) + 1).cast("int"))


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return (F.size(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[ \t-\r]+")) - F.when(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == "", 1).otherwise(0)).cast("long")


def weight_of(weights: dict[str, int], name: Column, default: int) -> Column:
    found = F.lit(default)
    for key, value in weights.items():
        found = F.when(name == key, F.lit(value)).otherwise(found)
    return found.cast("decimal(38,0)")


def split_budget(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each node its part of ``budget``, which all children of a parent carry.

    Shares go by ``weight``; a child takes at most its ``supply``, and what it
    leaves goes to its siblings by their weights, round after round. In the order
    of supply by weight, those that take all they have come first, so one pass of
    running sums settles it. Shares are rounded down to whole tokens.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("supply").cast("double") / F.col("weight").cast("double"), name)
    before = F.coalesce(F.sum("supply").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    out = nodes.withColumn("_left", F.greatest(F.col("budget") - before, F.lit(0)).cast("decimal(38,0)")).withColumn("_weights", weights.cast("decimal(38,0)"))
    out = out.withColumn("_full", F.col("supply") * F.col("_weights") <= F.col("_left") * F.col("weight"))
    # At the first child that doesn't take all it has: what is left, and the weights that share it.
    rest = F.first(F.when(~F.col("_full"), F.struct("_left", "_weights")), ignorenulls=True)
    out = out.withColumn("_rest", rest.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.call_function("div", F.col("_rest._left") * F.col("weight"), F.col("_rest._weights"))
    got = F.when(F.col("_full"), F.col("supply")).otherwise(F.least(F.col("supply"), share.cast("decimal(38,0)")))
    return out.withColumn("budget", got.cast("decimal(38,0)")).drop("_left", "_weights", "_full", "_rest")


def budgets(leaves: DataFrame, share_percent: int, max_epochs: int, weights: dict[str, dict[str, int]], default_weight: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf with tokens.

    The whole budget is ``share_percent`` of all tokens. A subtree's supply is its
    leaves' tokens times ``max_epochs``; so a shortage is met by siblings first,
    and moves up only when all of them give all they have.
    """
    big = "decimal(38,0)"
    nodes = leaves.where("tokens > 0").withColumn("supply", (F.col("tokens") * max_epochs).cast(big))
    total = F.call_function("div", F.sum("tokens").cast(big) * share_percent, F.lit(100).cast(big)).cast(big)
    above = nodes.groupBy().agg(total.alias("budget"))
    out = None
    for depth in range(1, len(LEVELS) + 1):
        here, name = list(LEVELS[:depth]), LEVELS[depth - 1]
        level = nodes.groupBy(*here).agg(F.sum("supply").cast(big).alias("supply"), F.sum("tokens").alias("tokens"))
        level = level.withColumn("weight", weight_of(weights.get(name, {}), F.col(name), default_weight)).where("weight > 0")
        level = level.join(F.broadcast(above)) if depth == 1 else level.join(out.select(*here[:-1], "budget"), here[:-1])
        out = split_budget(level, here[:-1] or [F.lit(0)], name).drop("weight")
    return out.select(*LEVELS, "tokens", F.col("budget").cast("long").alias("budget"))


def mix_sources(
    docs: DataFrame, share_percent: int = 60, max_epochs: int = 4, weights: dict[str, dict[str, int]] | None = None, default_weight: int = 1, seed: int = 11,
    domain: Column | None = None, tokens: Column | None = None, doc_id: str = "doc_id", lang: str = "lang", source: str = "source", text: str = "text",
) -> DataFrame:
    """Rows of ``docs`` chosen to target weights, each once per epoch that takes it, plus ``epoch`` (from 0) and ``domain``.

    ``weights`` gives relative weights by level and name, ``default_weight`` the
    rest; weight 0 leaves a node out. ``budgets`` gives each leaf its tokens. A
    leaf's documents are shuffled anew in each epoch, by md5 of seed, epoch and
    id; it takes whole epochs while its budget lasts, and of the next one the
    documents that begin before the budget ends. So a leaf is over its budget by
    a part of one document at most, and never under it.

    The place where a prefix ends is found from sums over 256 buckets of the order,
    then over 256 parts of the bucket that holds it, and again; only a 16-millionth
    of a leaf is sorted at last, so a leaf with most of all rows is never in one
    task. Null languages and sources are leaves named by an empty string; rows
    without tokens belong to no leaf's budget and are left out; null ids are ordered
    by their text's md5; repeated rows count apiece, those of one id by their text's
    md5. Input columns ``epoch`` and ``domain`` are replaced, all others stay.
    """
    some = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r")) != "" if tokens is None else tokens > 0
    domain = domain_of(F.col(source)) if domain is None else domain
    tokens = word_tokens(F.col(text)) if tokens is None else tokens
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    *key, name, full, part, last, before, place, inside, held, spent = fresh(docs, "_domain", "_lang", "_source", "_name", "_full", "_part", "_last", "_before", "_place", "_in", "_tokens", "_spent")
    leaf = dict(zip(key, (F.coalesce(domain, F.lit("")), F.coalesce(F.col(lang), F.lit("")), F.coalesce(F.col(source), F.lit("")))))
    rows = docs.withColumns(leaf | {name: F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), digest))})
    kept = [c for c in docs.columns if c.lower() not in {"epoch", "domain"} - {x.lower() for x in (doc_id, lang, source, text)}]
    known = materialize(rows.select(*key, name, tokens.alias(held)).where(F.col(held) > 0), "mix-tokens")
    sums = known.groupBy(*(F.col(k).alias(c) for k, c in zip(key, LEVELS))).agg(F.sum(held).alias("tokens"))
    plan = budgets(materialize(sums, "mix-leaves", narrow=True), share_percent, max_epochs, weights or {}, default_weight)
    plan = plan.select(*(F.col(c).alias(k) for k, c in zip(key, LEVELS)), F.expr("budget div tokens").alias(full), F.expr("budget % tokens").alias(part), F.lit("").alias(last), F.lit(0).cast("long").alias(before))
    plan = materialize(plan, "mix-plan", narrow=True)

    def ordered(df: DataFrame) -> DataFrame:
        return df.withColumn(place, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(full).cast("string"), F.col(name))))

    for depth in range(1, DEPTH + 1):
        edge = ordered(known.join(small(plan), key)).where((F.col(part) > 0) & F.col(place).startswith(F.col(last)))
        parts = edge.groupBy(*key, part, before, F.substring(place, 1, DIGITS * depth).alias("bucket")).agg(F.sum(held).alias("tokens"))
        until = F.col(before) + F.sum("tokens").over(Window.partitionBy(*key).orderBy("bucket"))
        parts = parts.withColumn("until", until).where(F.col("until") >= F.col(part))
        ends = parts.groupBy(*key).agg(F.min(F.struct("bucket", (F.col("until") - F.col("tokens")).alias("before"))).alias("end"))
        plan = materialize(plan.drop(last, before).join(ends, key, "left").select(*key, full, part, F.col("end.bucket").alias(last), F.col("end.before").alias(before)), "mix-ends", narrow=True)

    discard(known)

    laid = ordered(rows.join(small(plan), key))
    at = F.substring(place, 1, DIGITS * DEPTH)
    is_edge = F.coalesce(at == F.col(last), F.lit(False))
    inner = laid.where(~is_edge & some).withColumn(inside, F.coalesce(at < F.col(last), F.lit(False)))
    outer = laid.where(is_edge).withColumn(held, tokens).where(F.col(held) > 0)
    order = Window.partitionBy(*key).orderBy(place, name, held, digest).rowsBetween(Window.unboundedPreceding, -1)
    outer = outer.withColumn(spent, F.sum(held).over(order)).withColumn(inside, F.col(before) + F.coalesce(spent, F.lit(0)) < F.col(part)).drop(held, spent)
    both = inner.where((F.col(full) > 0) | F.col(inside)).unionByName(outer)
    whole = F.when(F.col(full) > 0, F.sequence(F.lit(0), (F.col(full) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    epochs = F.concat(whole, F.when(F.col(inside), F.array(F.col(full).cast("int"))).otherwise(F.array().cast("array<int>")))
    return both.select(*kept, F.col(key[0]).alias("domain"), F.explode(epochs).alias("epoch"))
