"""Verdicts on citations from the records that searches returned.

``attach_results`` brings a citation's search results together: a search returns
one page, so they are few. All rules after that are expressions over one row and
shuffle nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.schemas import EVIDENCE, OVERALL, RECORD
from docketry.functions.text import blank_to_null, bound, court_token, year_in
from docketry.sources.shared import stage

KEY = ["doc_id", "idx"]
STRATEGIES = ("name", "cite", "court")
#: Citations and courts of a case that an explanation names.
NAMED = 20


def attach_results(citations: DataFrame, results: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """``citations`` with ``name_results``, ``cite_results``, ``court_results`` (struct of rec, sim, lists by rank), ``name_found`` (how many there are), ``name_error`` etc., and ``overall``, what all records of the name are where they are more than a page.

    A citation without results has empty arrays; equal ranks go by cluster id.
    """
    own = lambda s, x: F.when(F.col("strategy") == s, x)
    scored = F.struct("rank", F.col("rec.cluster_id").alias("id"), F.struct("rec", "sim", "lists").alias("r"))
    results = results if "overall" in results.columns else results.withColumn("overall", F.lit(None).cast(OVERALL))
    rows = results.groupBy(*KEY).agg(
        F.first("overall", ignorenulls=True).alias("overall"),
        *(F.sort_array(F.collect_list(own(s, scored))).alias(f"_{s}") for s in STRATEGIES), *(F.max(own(s, F.col("found"))).alias(f"{s}_found") for s in STRATEGIES)
    )
    out = citations.join(rows, KEY, "left")
    none = F.array().cast(f"array<struct<rec:{RECORD},sim:double,lists:boolean>>")
    out = out.withColumns({f"{s}_results": F.coalesce(F.transform(f"_{s}", lambda x: x["r"]), none) for s in STRATEGIES} | {f"{s}_found": F.coalesce(f"{s}_found", F.lit(0)) for s in STRATEGIES})
    out = out.drop(*(f"_{s}" for s in STRATEGIES))
    if status is None:
        return out.withColumns({f"{s}_error": F.lit(None).cast("string") for s in STRATEGIES})
    errors = status.groupBy(*KEY).agg(*(F.max(F.when(F.col("strategy") == s, F.col("error"))).alias(f"{s}_error") for s in STRATEGIES))
    return out.join(errors, KEY, "left")


def slot_note() -> Column:
    """Why the absence of this reporter citation says little, or null. Partial reporters come first: their volume is a year too."""
    reporter = F.trim(F.coalesce("reporter", F.lit("")))
    return (
        F.when(blank_to_null("cite_key").isNull(), F.lit("no reporter citation is given"))
        .when(reporter.isin(fixed.PARTIAL_REPORTERS), F.concat(reporter, F.lit(" citations are indexed only in part; the case name is the main evidence")))
        .when(F.coalesce(F.col("volume"), F.lit("")).rlike("^(19|20)[0-9]{2}$"), F.concat(F.lit("'"), F.col("matched_text"), F.lit("' is a public-domain citation, which records do not list; only the case name can be checked")))
    )


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _first_of_most(array: Column, score) -> Column:
    """The first element with the highest score; null if the array is empty."""
    return bound(F.transform(array, score), lambda scores: F.get(array, (F.array_position(scores, F.array_max(scores)) - 1).cast("int")))


def _plain(scored: Column) -> Column:
    """A scored record without its scores."""
    return F.when(scored.isNotNull(), scored["rec"])


def gather_evidence(rows: DataFrame) -> DataFrame:
    """Add what the rules look at: scored results, slot owners, litigation records, the match by name, the confirming record."""
    named = blank_to_null("case_name").isNotNull()
    out = rows.withColumns({f"_{s}": F.col(f"{s}_results") for s in STRATEGIES})
    # Records of either search that list the citation; of equal ids the first.
    listing = F.filter(F.concat(F.when(named, F.col("_name")).otherwise(F.slice("_name", 1, 0)), F.when(blank_to_null("matched_text").isNotNull(), F.col("_cite")).otherwise(F.slice("_cite", 1, 0))), lambda r: r["lists"])
    out = out.withColumn("_listing", F.when(blank_to_null("cite_key").isNotNull(), listing).otherwise(F.slice(listing, 1, 0)))
    repeated = lambda r, i: F.exists(F.slice(F.col("_listing"), F.lit(1), i), lambda o: o["rec"]["cluster_id"].eqNullSafe(r["rec"]["cluster_id"]))
    out = out.withColumn("_owners", F.filter("_listing", lambda r, i: ~repeated(r, i)))
    out = out.withColumn("_litigation", F.when(named, F.filter("_name", lambda r: r["sim"] >= fixed.NAME_MATCH)).otherwise(F.slice("_name", 1, 0)))
    close = F.filter("_owners", lambda r: named & (r["sim"] >= fixed.NAME_MATCH_ON_SLOT))
    out = out.withColumn("_slot_match", _first_of_most(close, lambda r: r["sim"]))

    written = (F.col("court_source") == "document") & blank_to_null("court").isNotNull()
    affinity = lambda r: F.when(
        F.coalesce(written & blank_to_null(r["rec"]["court"]).isNotNull() & (court_token("court") == court_token(r["rec"]["court"])), F.lit(False)), 2
    ).otherwise(0) + F.when(F.coalesce(blank_to_null("year") == year_in(r["rec"]["date_filed"]), F.lit(False)), 1).otherwise(0)
    out = out.withColumn("_match", F.coalesce(_first_of_most(F.col("_litigation"), affinity), F.col("_slot_match")))
    by_name = F.concat(F.array_compact(F.array("_slot_match")), F.col("_litigation"))
    out = out.withColumn("_own", _first(F.filter(by_name, lambda r: r["lists"])))
    asked = F.col("_own").isNull() & (F.size(by_name) > 0) & blank_to_null("court_id").isNotNull() & F.col("court_error").isNull()
    out = out.withColumn("_asked_court", asked)
    out = out.withColumn("_in_court", F.when(asked, F.filter("_court", lambda r: r["lists"])))
    out = out.withColumn("_court_hit", _first(F.filter("_in_court", lambda r: r["sim"] >= fixed.NAME_MATCH_ON_SLOT)))
    return out.withColumn("_confirming", F.coalesce("_own", "_court_hit"))


def decide(rows: DataFrame, strict: bool = False) -> DataFrame:
    """``gather_evidence``'s rows with ``rule``, ``verdict``, ``error_class``, ``confidence``, ``resolved``, ``slot_owner`` and ``suggestion``.

    The rules are tried in order and the first that holds decides:

    D1 no name, but a record holds the citation: verified. D2 both searches
    failed: not checked. D3 a record of that name lists the citation: verified.
    D4 only other cases hold it: miscited. D5, D6 all records of that name are of
    other courts than the document writes: fabricated if the court is a circuit,
    else miscited. D7 nothing disagrees: not checked. D8 no such name, the citation
    is another case's: fabricated. D9 nothing to check. D10 found nowhere: fabricated.

    ``strict``: one failed search is enough for not checked where nothing was
    found, and D5 takes only ids of federal circuits.
    """
    named = blank_to_null("case_name").isNotNull()
    owners, first_owner = F.size("_owners") > 0, _first(F.col("_owners"))
    unrelated = F.filter("_owners", lambda r: r["sim"] < fixed.NAME_MATCH_ON_SLOT)
    courts = F.filter(F.transform("_litigation", lambda r: r["rec"]["court"]), lambda c: blank_to_null(c).isNotNull())
    lists = F.exists(F.concat("_litigation", "_owners"), lambda r: r["lists"])
    other_court = (
        F.coalesce((F.col("court_source") == "document"), F.lit(False)) & blank_to_null("court").isNotNull() & (F.size(courts) > 0)
        & ~F.exists(courts, lambda c: court_token(c) == court_token("court")) & ~lists & F.col("_court_hit").isNull()
    )
    circuit = F.coalesce(F.col("court_id").rlike("^ca([0-9]+|dc|fc)$" if strict else "^ca"), F.lit(False))
    name_failed, cite_failed = named & F.col("name_error").isNotNull(), blank_to_null("cite_key").isNotNull() & F.col("cite_error").isNotNull()
    match, confirming = F.col("_match"), F.col("_confirming")
    one_failed = (name_failed | cite_failed) if strict else F.lit(False)
    rule = (
        F.when(~named & owners, "D1")
        .when(name_failed & cite_failed, "D2")
        .when(confirming.isNotNull(), "D3")
        .when(match.isNotNull() & owners & (F.size(unrelated) == F.size("_owners")), "D4")
        .when(match.isNotNull() & other_court & circuit, "D5")
        .when(match.isNotNull() & other_court, "D6")
        .when(match.isNotNull(), "D7")
        .when(owners, "D8")
        .when(one_failed, "D2")
        .when(~named & slot_note().isNotNull(), "D9")
        .otherwise("D10")
    )
    out = rows.withColumns({"rule": rule, "_courts": courts})
    of = lambda **by: F.coalesce(*(F.when(F.col("rule").isin(rules.split()), F.lit(value)) for value, rules in by.items()))
    weak = slot_note().isNotNull()
    confidence = F.when(F.col("rule") == "D10", F.when(weak, 0.7).otherwise(0.9))
    for names, value in (("D1", 0.75), ("D3", 0.95), ("D4", 0.85), ("D5 D8", 0.9), ("D6", 0.8), ("D2 D7 D9", 0.0)):
        confidence = F.when(F.col("rule").isin(names.split()), F.lit(value)).otherwise(confidence)
    resolved = F.when(F.col("rule") == "D1", _plain(first_owner)).when(F.col("rule") == "D3", _plain(confirming)).when(F.col("rule").isin("D4", "D5", "D6", "D7"), _plain(match))
    out = out.withColumns(
        {
            "verdict": of(verified="D1 D3", miscited="D4 D6", fabricated="D5 D8 D10", unverifiable="D2 D7 D9"),
            "error_class": of(none="D1 D3", not_checked="D2 D7 D9", wrong_slot="D4", fabricated_cite="D5 D10", wrong_court="D6", fabricated_case_name="D8"),
            "confidence": confidence.cast("double"),
            "resolved": resolved,
            "slot_owner": F.when(F.col("rule") == "D4", _plain(_first(unrelated))).when(F.col("rule") == "D8", _plain(first_owner)),
        }
    )
    known_as = F.get(F.col("resolved.citations"), F.lit(0))
    return out.withColumn("suggestion", F.when(F.col("rule").isin("D4", "D6") & known_as.isNotNull(), F.concat(F.col("resolved.case_name"), F.lit(", "), known_as)))


#: The records that a verdict tells of.
TOLD = ("resolved", "slot_owner", "_best", "_owner", "_court_top")


def told_apart(rows: DataFrame) -> DataFrame:
    """``decide``'s rows without the searches' results: what reports tell of them, and the records told of, each once, in ``_records``, with their places there."""
    # Beyond a page, the records of a name are known by what ``overall`` gathers of all of them.
    all_, none = F.col("overall"), F.array().cast("array<string>")
    cites = lambda records: F.flatten(F.transform(records, lambda r: r["rec"]["citations"]))
    listed = lambda values: F.array_sort(F.array_distinct(F.concat(*(F.coalesce(v, none) for v in values))))
    first = lambda values: bound(values, lambda xs: F.concat(F.array_join(F.slice(xs, 1, NAMED), ", "), F.when(F.size(xs) > NAMED, " and more").otherwise("")))
    known = F.coalesce(blank_to_null(first(listed([all_["citations"], cites(F.concat("_litigation", "_owners"))]))), F.lit("no citation"))
    courts = first(listed([all_["courts"], F.col("_courts")]))
    count = F.coalesce(all_["found"], F.size("_litigation")) + F.size(F.filter("_owners", lambda r: r["sim"] < fixed.NAME_MATCH))
    on_page = _first_of_most(F.filter("_name", lambda r: r["sim"] > 0), lambda r: r["sim"])
    rows = rows.withColumn("_on_page", on_page)
    better = F.coalesce(all_["sim"] > F.coalesce(F.col("_on_page.sim"), F.lit(0.0)), F.lit(False))
    said = lambda rules, x: F.when(F.col("rule").isin(rules.split()), x)
    rows = rows.withColumns(
        {
            "_known": said("D4 D6 D7", known), "_court_names": said("D6", courts), "_count": said("D7", count), "_weak_name": F.when(F.col("_slot_match.sim") < fixed.NAME_MATCH, F.col("_slot_match.rec.case_name")),
            "_best": F.when(better, all_["rec"]).otherwise(_plain(F.col("_on_page"))), "_best_sim": F.when(better, all_["sim"]).otherwise(F.col("_on_page.sim")), "_owner_count": F.size("_owners"), "_owner": _plain(_first(F.col("_owners"))),
            "_court_told": F.col("_court_hit").isNotNull(), "_court_top": F.coalesce(_plain(F.col("_court_hit")), _plain(_first(F.col("_in_court")))),
        }
    )
    rows = rows.withColumn("_records", F.array_distinct(F.array_compact(F.array(*TOLD))))
    places = {f"_at_{c}": F.array_position("_records", F.col(c)).cast("int") for c in TOLD}
    kept = ("_records", "_known", "_court_names", "_count", "_weak_name", "_best_sim", "_owner_count", "_court_told", "_asked_court", *places)
    rows = rows.withColumns(places)
    return rows.select(*(c for c in rows.columns if c in kept or not (c.startswith("_") or c in TOLD or c == "overall" or c in {f"{s}_results" for s in STRATEGIES})))


def explain_verdicts(rows: DataFrame) -> DataFrame:
    """``decided_rows`` with ``resolved``, ``slot_owner``, ``explanation``, ``advisories`` and ``evidence``, without the helper columns."""
    rows = rows.withColumns({c: F.get("_records", F.col(f"_at_{c}") - 1) for c in TOLD})
    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    text, name = F.coalesce("matched_text", F.lit("")), F.coalesce("case_name", F.lit(""))
    known, courts, records = F.col("_known"), F.col("_court_names"), F.col("_count")
    says = {
        "D1": F.concat(text, F.lit(" belongs to "), F.col("resolved.case_name"), F.lit("; without a case name only the citation was checked.")),
        "D2": F.concat(F.lit("No search could be run: "), F.coalesce("name_error", "cite_error")),
        "D3": F.concat(F.lit("A record of this case lists "), text, F.lit(".")),
        "D4": F.concat(F.lit("This case exists, but "), text, F.lit(" belongs to "), F.col("slot_owner.case_name"), F.lit("; the case is recorded under "), known, F.lit(".")),
        "D5": F.concat(F.lit("This case exists in another court, and "), text, F.lit(" was not found in the court given.")),
        "D6": F.concat(F.lit("All records of this case are of other courts ("), courts, F.lit("), not of "), F.col("court"), F.lit("; it is recorded under "), known, F.lit(".")),
        "D7": F.concat(F.lit("This case exists; its records ("), records.cast("string"), F.lit(") list "), known, F.lit(" and neither confirm nor rule out "), text, F.lit(".")),
        "D8": F.concat(F.lit("No case is named "), quoted(name), F.lit(", and "), text, F.lit(" belongs to "), F.col("slot_owner.case_name"), F.lit(".")),
        "D9": F.lit("There is neither a case name nor a reporter citation to check."),
        "D10": F.concat(F.when(blank_to_null("case_name").isNotNull(), F.concat(F.lit("No case is named "), quoted(name))).otherwise(F.lit("No record was found")), F.lit(", and none holds "), text, F.lit(".")),
    }
    explanation = F.lit(None).cast("string")
    for rule, words in says.items():
        explanation = F.when(F.col("rule") == rule, words).otherwise(explanation)

    own_year, written = year_in(F.col("resolved.date_filed")), blank_to_null("court").isNotNull() & (F.col("court_source") == "document")
    decided = F.col("verdict") != "unverifiable"
    notes = [
        slot_note(),
        F.when(blank_to_null("case_name").isNull(), F.lit("no case name is given, so only the reporter citation was checked")),
        F.concat(F.lit("the name given, "), quoted(name), F.lit(", differs from the recorded "), quoted(F.col("_weak_name"))),
        F.when(decided & (blank_to_null("year") != own_year), F.concat(F.lit("year given "), F.col("year"), F.lit(", recorded "), own_year)),
        F.when(
            decided & written & blank_to_null("resolved.court").isNotNull() & (court_token("court") != court_token("resolved.court")),
            F.concat(F.lit("court given "), F.col("court"), F.lit(", recorded "), F.regexp_replace("resolved.court", r"\.+$", "")),
        ),
    ]
    advisories = F.concat(F.coalesce("extraction_notes", F.array().cast("array<string>")), F.array_compact(F.array(*notes)))

    count = lambda s: F.col(f"{s}_found")
    phrase = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    row = lambda strategy, query, n, matched, top, note: F.struct(F.lit(strategy), query, n, matched, top, note).cast(EVIDENCE)
    score = F.format_string("%.2f", F.coalesce("_best_sim", F.lit(0.0)))
    by_name = F.when(
        blank_to_null("case_name").isNotNull(),
        row("case_name_search", phrase(F.col("case_name")), count("name"), F.coalesce(F.col("_best_sim") >= fixed.NAME_MATCH, F.lit(False)), F.col("_best"),
            F.coalesce("name_error", F.when(count("name") > 0, F.concat(F.lit("best name score "), score)).otherwise(F.lit("no results")))),
    )
    by_cite = F.when(
        blank_to_null("cite_key").isNotNull() & blank_to_null("matched_text").isNotNull(),
        row("reporter_citation_search", phrase(F.col("matched_text")), count("cite"), F.col("_owner_count") > 0, F.col("_owner"),
            F.when(F.col("_owner_count") > 0, F.concat(F.col("_owner_count").cast("string"), F.lit(" record(s) list this citation"))).otherwise(F.coalesce("cite_error", F.lit("no record of either search lists this citation")))),
    )
    in_court = F.when(
        F.col("_asked_court"),
        row("reporter_citation_search_in_court", F.concat(phrase(F.col("matched_text")), F.lit(" court="), F.col("court_id")), count("court"), F.col("_court_told"), F.col("_court_top"),
            F.when(F.col("_court_told"), F.lit("found in this court")).otherwise(F.lit("not found in this court"))),
    )
    out = rows.withColumns({"explanation": explanation, "advisories": advisories, "evidence": F.array_compact(F.array(by_name, by_cite, in_court))})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def decided_rows(citations: DataFrame, results: DataFrame, status: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """What is decided, staged: so that a filter on a verdict is one on a stored column, and not copied into all that the verdict is made of. Each record is stored once a row."""
    return stage(told_apart(decide(gather_evidence(attach_results(citations, results, status)), strict)), "decided")


def findings(citations: DataFrame, results: DataFrame, status: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Citations with their verdicts, given what the searches returned (RESULTS and STATUS)."""
    return explain_verdicts(decided_rows(citations, results, status, strict))
