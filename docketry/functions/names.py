"""Case names as Column expressions: identity tokens, party split, similarity, plausibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.text import _c, bound, normalized


def _none() -> Column:
    return F.array().cast("array<string>")


def plain_name(x) -> Column:
    """A name in lower case, & as a word, other signs as spaces."""
    spelled = F.replace(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def identity_tokens(x) -> Column:
    """Distinct tokens that identify a party: without noise words, unless there are no others."""
    every = F.filter(F.array_distinct(F.split(plain_name(x), " ")), lambda t: t != "")
    some = lambda tokens: F.filter(tokens, lambda t: ~t.isin(fixed.NOISE_WORDS))
    return bound(every, lambda tokens: bound(some(tokens), lambda telling: F.when(F.size(telling) > 0, telling).otherwise(tokens)))


def abbreviated(x) -> Column:
    """Tokens that a name writes with a full stop, in lower case."""
    return F.coalesce(F.transform(F.regexp_extract_all(_c(x), F.lit(fixed.ABBREVIATED_TOKEN), F.lit(1)), F.lower), _none())


def sides(x) -> Column:
    """[plaintiff, defendant], or null where no ``v.`` parts the name."""
    parts = F.split(F.trim(_c(x)), r"(?i)\s+v\.?\s+", 2)
    return bound(parts, lambda p: F.when(F.size(p) == 2, F.transform(p, F.trim)))


def contained(cited: Column, candidate: Column, short: Column) -> Column:
    """The share of the cited tokens that the candidate has; an abbreviated token also counts as the beginning of a longer one."""
    fits = lambda t: F.array_contains(candidate, t) | (F.array_contains(short, t) & F.exists(candidate, lambda o: o.startswith(t) & (F.length(o) > F.length(t))))
    return F.when(F.size(cited) == 0, F.lit(0.0)).otherwise(F.size(F.filter(cited, fits)) / F.size(cited))


def name_parts(x) -> Column:
    """What similarity needs of a name, computed once: tokens of all, of each side, and abbreviations."""
    return bound(
        sides(x),
        lambda split: F.struct(
            identity_tokens(x).alias("all"),
            F.when(split.isNotNull(), identity_tokens(split[0])).alias("left"),
            F.when(split.isNotNull(), identity_tokens(split[1])).alias("right"),
            abbreviated(x).alias("short"),
        ),
    )


def parts_similarity(cited: Column, candidate: Column) -> Column:
    """How well a candidate's parts fit the cited ones, from 0 to 1. Both parties have to fit, so the weaker side counts."""
    both = cited["left"].isNotNull() & candidate["left"].isNotNull()
    each = [contained(cited[s], candidate[s], cited["short"]) for s in ("left", "right")]
    return F.when(both, F.least(*each)).otherwise(contained(cited["all"], candidate["all"], cited["short"]))


def name_similarity(cited, candidate) -> Column:
    return parts_similarity(name_parts(_c(cited)), name_parts(_c(candidate)))


def is_plausible_party(x) -> Column:
    """Whether a text reads as a name: at most 20 tokens, each with a capital or a digit first, or a connecting word."""
    bare = lambda t: F.regexp_replace(t, r"^[,.;:()\[\]&'’]+|[,.;:()\[\]&'’]+$", "")
    fits = lambda t: bound(bare(t), lambda b: (b == "") | b.rlike(r"^[\p{Lu}\p{Nd}]") | F.lower(b).isin(fixed.CONNECTORS))
    return bound(normalized(x), lambda name: (name != "") & bound(F.split(name, " "), lambda tokens: (F.size(tokens) <= 20) & F.forall(tokens, fits)))
