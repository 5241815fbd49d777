"""URL filters: rules found by their rarest literal token; only the rules found run their regular expressions."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import fresh

TOKEN = re.compile(r"[a-z0-9]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``regex`` runs (search) over host + path. ``tokens``: those every match holds whole; ``either``: tokens of which every match holds one. Of the rules that match, the highest rank wins."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    rank: tuple[int, int, int]
    scoped: bool
    either: tuple[str, ...] = ()


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host and all its subdomains where the path starts with ``path``. Longer rules rank higher.

    The host's labels are whole tokens of every match; so are the path's, but for
    one at its end, which may go on in the URL.
    """
    tokens = TOKEN.findall(host) + [m.group() for m in TOKEN.finditer(path.lower()) if m.end() < len(path)]
    regex = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}" if path.startswith("/") else rf"^(?:[^/?#]*\.)?{re.escape(host)}(?=/|$){re.escape(path)}"
    return Rule(f"{host}{path}", verdict, regex, tuple(tokens), (1, len(host) + len(path), len(host)), True)


def pattern_rule(verdict: str, name: str, regex: str, tokens: tuple[str, ...] = (), either: tuple[str, ...] = ()) -> Rule:
    """A rule by a regular expression over host + path; ``tokens`` and ``either`` as in Rule. Without them it runs on every URL."""
    return Rule(name, verdict, regex, tokens, (0, len(name), 0), False, either)


#: Rules of the filter's own, for URLs that no site rule fits. Literal words are whole where the pattern bounds them.
PATTERNS = (
    pattern_rule("block", "spam host", r"^(?:[^/]*[.-])?spam(?:[.-][^/]*)?(?:/|$)", ("spam",)),
    pattern_rule("block", "pills host", r"^(?:[^/]*[.-])?pills(?:[.-][^/]*)?(?:/|$)", ("pills",)),
    pattern_rule("block", "casino host", r"^(?:[^/]*[.-])?casino(?:[.-][^/]*)?(?:/|$)", ("casino",)),
    pattern_rule("block", "adult host", r"^(?:[^/]*[.-])?(?:xxx|porn)(?:[.-][^/]*)?(?:/|$)", either=("xxx", "porn")),
    pattern_rule("block", "tracker path", r"/(?:track|tracker|pixel)(?:\.gif|/|$)", either=("track", "tracker", "pixel")),
    pattern_rule("block", "login page", r"/wp-login\.php$", ("wp", "login", "php")),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null and URLs without ``://`` have an empty one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_of(rows: DataFrame) -> list[Rule]:
    """Rules from a table: (verdict, host, path) for a site, or (verdict, name, regex, tokens, either) for a pattern, whose ``host`` is null.

    Columns that are missing are null. The rules, not the URLs, come to the driver.
    """
    out = []
    for r in rows.distinct().collect():
        get = r.asDict().get
        if get("host") is not None:
            out.append(site_rule(get("verdict"), get("host"), get("path") or ""))
        else:
            out.append(pattern_rule(get("verdict"), get("name") or get("regex"), get("regex"), tuple(get("tokens") or ()), tuple(get("either") or ())))
    return sorted(out)


def token_counts(urls: DataFrame, rules, host: str, path: str) -> dict[str, int]:
    """In how many of all URLs each token of the rules is found. As many rows as the rules have tokens reach the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    asked = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    tokens = F.array_distinct(F.split(F.translate(F.concat(host, F.lit("/"), path), UPPER, LOWER), "[^a-z0-9]+"))
    rows = urls.select(F.explode(tokens).alias("token")).join(F.broadcast(asked), "token", "left_semi").groupBy("token").count().collect()
    return dict.fromkeys(wanted, 0) | {r["token"]: r["count"] for r in rows}


def rule_index(rules, counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rarest token -> rules; those with a choice of tokens are under each of them, those without a token under ''."""
    index = defaultdict(list)
    for r in rules:
        for token in [min(r.tokens, key=lambda t: (counts.get(t, 0), t))] if r.tokens else r.either or [""]:
            index[token].append(r)
    return dict(index)


def match_rules(index: dict[str, list[Rule]]):
    """A pandas UDF: (host, path) -> struct of the winning rule, and how many rules ran."""
    plain = {k: [tuple(r) for r in v] for k, v in index.items()}

    @F.pandas_udf("name string, verdict string, scoped boolean, rank0 int, rank1 int, rank2 int, tried int")
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        token = re.compile("[a-z0-9]+")
        ready = {k: [(re.compile(x[2]).search, x) for x in v] for k, v in plain.items()}
        always = ready.pop("", [])

        def one(host: str, path: str) -> tuple:
            url, won, tried = host + path, None, 0
            if url:
                lists = [always, *(ready[t] for t in set(token.findall(url.translate(ASCII))) if t in ready)]
                for fits, rule in (x for some in lists for x in some):
                    tried += 1
                    if (won is None or (rule[4], rule[0]) > (won[4], won[0])) and fits(url):
                        won = rule
            return (won[0], won[1], won[5], *won[4], tried) if won else (None, None, None, None, None, None, tried)

        for hosts, paths in batches:
            out = pd.DataFrame([one(h, p) for h, p in zip(hosts, paths)], columns=["name", "verdict", "scoped", "rank0", "rank1", "rank2", "tried"])
            yield out.astype({"rank0": "Int32", "rank1": "Int32", "rank2": "Int32", "scoped": "boolean"})

    return best


ASCII = str.maketrans(UPPER, LOWER)
#: Most rules that one pass sends to the executors; more rules take more passes over the URLs, in one plan.
RULES_PER_PASS = 50_000


def filter_urls(pages: DataFrame, rules, patterns=PATTERNS, url: str = "url", rules_per_pass: int = RULES_PER_PASS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` is the longest site rule that fits, else null; the verdict is that
    rule's, else that of the first-ranked pattern, else allow. Null URLs and those
    without ``://`` have an empty host and path, which no rule fits: allowed. Equal
    rows get equal results. Input columns with a result's name are replaced, all
    others stay. A table of rules becomes ``rules`` and ``patterns`` by ``rules_of``.
    Nothing is shuffled but the counts of the rules' tokens over all URLs.
    """
    known = [*rules, *patterns]
    clash = {"host", "path", "rule", "verdict"} & {c.lower() for c in pages.columns} - {url.lower()}
    out = pages.drop(*(c for c in pages.columns if c.lower() in clash)).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    counts = token_counts(out, known, "host", "path")
    fields = ["rank0", "rank1", "rank2", "name", "verdict", "scoped"]
    starts = range(0, max(1, len(known)), rules_per_pass)
    best, *passes = helpers = fresh(out, "_best", *(f"_best{k}" for k in starts))
    found = []
    for k, name in zip(starts, passes):
        out = out.withColumn(name, match_rules(rule_index(known[k : k + rules_per_pass], counts))("host", "path"))
        found.append(F.when(F.col(f"{name}.name").isNotNull(), F.struct(*(F.col(f"{name}.{f}").alias(f) for f in fields))))
    out = out.withColumn(best, F.greatest(*found) if len(found) > 1 else found[0])
    out = out.withColumn("rule", F.when(F.col(f"{best}.scoped"), F.col(f"{best}.name"))).withColumn("verdict", F.coalesce(f"{best}.verdict", F.lit("allow")))
    return out.drop(*helpers)
