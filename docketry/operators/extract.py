"""Citations in documents: a scan finds the forms and cuts out what stands around them; expressions read it, windows attribute short forms.

Only the scan and the split into sentences are sequential; they run as one pass
of Python over each document, and its text goes no further.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import fixed
from docketry.functions.names import is_plausible_party, plain_name, sides
from docketry.functions.schemas import CITATION
from docketry.functions.text import blank_to_null, cite_key, court_written, normalized, one_line

# Reporter forms -> kind and the court that the reporter tells, where it tells one.
REPORTERS = {
    r"U\.\s?S\.(?!\s?C)": ("case", "scotus"), r"S\.\s?Ct\.": ("case", "scotus"), r"L\.\s?Ed\.(?:\s?2d)?": ("case", "scotus"),
    r"F\.\s?(?:2d|3d|4th)": ("case", None), r"F\.\s?Supp\.(?:\s?[23]d)?": ("case", None), r"F\.\s?App'x|Fed\.\s?Appx\.?": ("case", None), r"F\.R\.D\.": ("case", None), r"B\.R\.": ("case", None),
    r"A\.\s?(?:2d|3d)": ("case", None), r"P\.\s?(?:2d|3d)": ("case", None), r"N\.E\.(?:\s?[23]d)?": ("case", None), r"N\.W\.(?:\s?2d)?": ("case", None),
    r"S\.E\.(?:\s?2d)?": ("case", None), r"S\.W\.(?:\s?[23]d)?": ("case", None), r"So\.(?:\s?[23]d)?": ("case", None),
    r"A\.D\.(?:\s?[23]d)?": ("case", "nyappdiv"), r"N\.Y\.(?:\s?[23]d)?": ("case", "ny"), r"N\.Y\.S\.(?:\s?[23]d)?": ("case", None), r"Misc\.(?:\s?[23]d)?": ("case", None),
    r"N\.J\.\s?Super\.": ("case", None), r"N\.J\.(?!\s?Super)": ("case", "nj"), r"Cal\.\s?App\.(?:\s?(?:2d|3d|4th|5th))?": ("case", "calctapp"), r"Cal\.\s?Rptr\.(?:\s?[23]d)?": ("case", None), r"Cal\.(?:\s?(?:2d|3d|4th|5th))?(?!\s?(?:App|Rptr))": ("case", "cal"),
    r"Ill\.\s?(?:2d|App\.\s?[23]d)": ("case", None), r"IL\s?App\s?\([1-5](?:st|nd|rd|d|th)\)": ("case", "illappct"), r"Mass\.(?:\s?App\.\s?Ct\.)?": ("case", None), r"Ohio\s?St\.(?:\s?[23]d)?": ("case", None), r"Tex\.": ("case", None),
    r"WL": ("case", None), r"U\.S\.\s?(?:App\.\s?)?LEXIS|LEXIS": ("case", None),
    r"U\.\s?S\.\s?C\.(?:\s?A\.)?": ("statute", None), r"C\.\s?F\.\s?R\.": ("statute", None), r"Stat\.": ("statute", None), r"Fed\.\s?Reg\.": ("statute", None),
    r"(?:[A-Z][a-z]+\.\s){0,2}L\.\s?(?:Rev\.|J\.)": ("journal", None),
}

# Written courts -> ids, for courts that no reporter tells.
COURTS = {
    r"^2d Cir\.?": "ca2", r"^3d Cir\.?": "ca3", r"^D\.?\s?C\.? Cir\.?": "cadc", r"^Fed\.? Cir\.?": "cafc", r"^S\.?D\.?N\.?Y": "nysd", r"^E\.?D\.?N\.?Y": "nyed",
    r"^D\.?D\.?C": "dcd", r"^S\.?D\.? Ga": "gasd", r"^S\.?D\.? Fla": "flsd", r"^N\.?D\.? Cal": "cand", r"^C\.?D\.? Cal": "cacd", r"^N\.?D\.? Ill": "ilnd",
}


# A volume and a reporter, then a page, or "at" and a page of a short form; "Id." and "supra". One pass over a text finds all.
_BY_KIND = {kind: "|".join(p for p, (k, _) in REPORTERS.items() if k == kind) for kind in ("case", "statute", "journal")}
_FORMS = re.compile(
    "|".join(
        [
            rf"(?<![\w.])(?P<{k}_volume>\d{{1,4}})\s(?P<{k}_reporter>{_BY_KIND[k]})(?:,?\sat\s(?P<{k}_at>\d{{1,5}})(?!\w)|\s?{section}(?P<{k}_page>{page})(?!\w))"
            for k, section, page in (("case", "", r"\d{1,8}(?:-U)?[a-z]?"), ("statute", r"§{0,2}\s?", r"\d{1,8}[a-z]{0,2}(?:[.-]\d+)?"), ("journal", "", r"\d{1,8}(?:-U)?[a-z]?"))
        ]
        + [r"(?<!\w)(?P<id>(?:[Ii]d\.|[Ii]bid\.)(?:,?\sat\s\d{1,5}(?:[-–]\d{1,5})?)?)", r"(?<!\w)(?P<supra>supra(?!\w)(?:,?\sat\s\d{1,5})?)"]
    )
)
_BARE_NUMBER = re.compile(r"\d+(?![^\W_])")
_PIN = re.compile(r",\s?(\d{1,5}(?:[-–]\d{1,5})?)(?=[\s,.;)(]|$)(?!\s[A-Z])")


@lru_cache(maxsize=4096)
def told_by(reporter: str, after: str) -> str | None:
    """The court that a written reporter tells. ``after``: the text that follows it, which some forms exclude."""
    return next((told for pattern, (_, told) in REPORTERS.items() if (m := re.match(pattern, reporter + after)) and m.end() == len(reporter)), None)


def scan_citations(text: str | None) -> list[tuple]:
    """(start, end, form, text, volume, reporter, page, pin, kind, court told by the reporter) of each citation, in order.

    ``form`` is full, short (``550 U.S., at 556``), id or supra. Matches don't overlap: the earliest stays.
    """
    out, body = [], text or ""
    for m in _FORMS.finditer(body):
        found = m.groupdict()
        if found["id"] or found["supra"]:
            out.append((m.start(), m.end(), "id" if found["id"] else "supra", m[0], None, None, None, None, "other", None))
            continue
        kind = next(k for k in _BY_KIND if found[f"{k}_volume"])
        volume, reporter, at, page = (found[f"{kind}_{x}"] for x in ("volume", "reporter", "at", "page"))
        end = m.end(f"{kind}_reporter")
        pin = None if at else _PIN.match(body[m.end() : m.end() + 20])
        # Numbers that no letter follows mean the same to all forms: with one for all, what was told is remembered.
        after = _BARE_NUMBER.sub("0", body[end : end + 8])
        out.append((m.start(), m.end(), "short" if at else "full", m[0], volume, reporter, at or page, pin and pin[1], kind, told_by(reporter, after)))
    return out


_SHORT = frozenset(fixed.ABBREVIATIONS)
_STOP = re.compile(r"[.!?](?=\s+[\"“(\[]*[A-Z]|\s*$)")
_WORD_OR_STOPS = re.compile(r"(?:[^\W_]|\.)*")


def sentence_ends(text: str | None) -> list[int]:
    """Where each sentence of a text ends. A stop ends one if a capital follows after white space, or nothing does, and it closes no abbreviation or initial."""
    body = text or ""
    ends = []
    for m in _STOP.finditer(body):
        if m[0] == ".":
            # Read backwards, as a search for what ends a text tries all its beginnings.
            before = _WORD_OR_STOPS.match(body[max(0, m.start() - 40) : m.start()][::-1])[0][::-1].replace(".", "").lower()
            if before and (len(before) == 1 or before in _SHORT):
                continue
        ends.append(m.end())
    if not ends or ends[-1] < len(body):
        ends.append(len(body))
    return ends


MENTION = "s:int,e:int,form:string,matched_text:string,volume:string,reporter:string,page:string,pin:string,kind:string,told:string,lead:string,before:string,after:string,rest:string,context:string"

#: Characters of mentions after which a step hands back what it has, and what a mention counts besides what stands around it.
MOST_HELD, MENTION_CHARS = 4_000_000, 1_000


def surroundings(text: str, found: list[tuple], ends: list[int]) -> list[tuple]:
    """What stands around each citation: before it, as far as its neighbour and LOOK_BEHIND allow, and then as its sentence does, too; after it, as far as its neighbour and LOOK_AHEAD; 80 characters more; its sentence with the one before it."""
    out = []
    for k, (s, e, *_) in enumerate(found):
        own, last = bisect_right(ends, s), bisect_left(ends, s)
        wide = max(found[k - 1][1] if k else 0, s - fixed.LOOK_BEHIND)
        floor = max(wide, ends[last - 1] if last else 0)
        limit = min(found[k + 1][0] if k + 1 < len(found) else len(text), e + fixed.LOOK_AHEAD)
        begin, end = ends[own - 2] if own > 1 else 0, ends[own] if own < len(ends) else len(text)
        out.append((text[wide:s], text[floor:s], text[e : max(limit, e)], text[e : e + 80], text[begin:end].strip(" ")))
    return out


def scanned_in_steps(texts: Iterable[str | None], most_held: int) -> Iterator[pd.DataFrame]:
    """(mentions, ends) of each text, handed back whenever they hold ``most_held`` characters or more."""
    names = [x.split(":")[0] for x in MENTION.split(",")]
    rows, held = [], 0
    for x in texts:
        found = scan_citations(x)
        ends = sentence_ends(x) if found else []
        around = surroundings(x or "", found, ends)
        rows.append(([dict(zip(names, m + a)) for m, a in zip(found, around)], ends))
        held += MENTION_CHARS * len(found) + sum(len(part) for a in around for part in a)
        if held >= most_held:
            yield pd.DataFrame(rows, columns=["mentions", "ends"])
            rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["mentions", "ends"])


def scan_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_held: int = MOST_HELD) -> DataFrame:
    """(doc_id, text, mentions, ends): each document's normalised text, its mentions with what stands around them, and the ends of its sentences.

    Null and blank texts have no mentions. Other columns are left behind. What stands
    around mentions is many times their texts, so it goes back after ``most_held``
    characters, or one text that has more, however many texts came in at once.
    """
    known = docs.select(F.col(doc_id).cast("string").alias("doc_id"), normalized(text).alias("text"))

    # Given their type, mentions become Arrow in one step; as frames they are converted a value at a time.
    @F.arrow_udf(f"mentions array<struct<{MENTION}>>, ends array<int>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mention = pa.struct([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (x.split(":") for x in MENTION.split(","))])
        for texts in batches:
            for step in scanned_in_steps(texts.to_pylist(), most_held):
                columns = [pa.array(step["mentions"].tolist(), pa.list_(mention)), pa.array(step["ends"].tolist(), pa.list_(pa.int32()))]
                yield pa.StructArray.from_arrays(columns, ["mentions", "ends"])

    return known.withColumn("_scan", scan("text")).select("doc_id", "text", "_scan.mentions", "_scan.ends")


# Words before a name that are no part of it.
SIGNALS = ["See", "Compare", "Accord", "But", "Cf.", "E.g.", "E.g.,", "Contra", "In", "Under", "The", "Citing", "Quoting", "And", "As", "Also", "also", "generally", "of", "the", "and", "in", "on", "for", "by", "as", "a", "an", "e.g.", "e.g.,", "cf."]


_NAME_WORD = r"(?:[\p{Lu}\p{Nd}][\p{L}\p{Nd}.'’&\-]*|of|the|and|&|de|del|la|le|van|von|der|den|ex|rel\.|in|re|on|for|by|as|a|an)"
#: A word of three letters or more, by which a party is found again in the text.
_LONG_WORD = r"([A-Za-z][A-Za-z'\-]{2,})"


def without_signals(name: Column) -> Column:
    signal = "|".join(x.replace(".", r"\.") for x in sorted(SIGNALS, key=lambda x: -len(x)))
    return blank_to_null(F.trim(F.regexp_replace(name, rf"^(?:(?:{signal})\s)+(?=[\p{{Lu}}\p{{Nd}}])", "")))


def name_before(window: Column) -> Column:
    """The case name that ends a text: the run of name words around its last ``v.``, without the signal words it begins with."""
    return without_signals(F.regexp_extract(window, rf"((?:{_NAME_WORD},?\s)*{_NAME_WORD},?\s[Vv]s?\.?\s(?:{_NAME_WORD},?\s)*{_NAME_WORD})[\s,]*$", 1))


def parties_read(lead: Column) -> tuple[Column, Column]:
    """(plaintiff, defendant) by a first reading: the name words before the last ``v.``, and all that follows it."""
    before_v = F.regexp_extract(lead, r"(?s)^(.*[^,]),?\s[Vv]s?\.?\s", 1)
    plaintiff = F.regexp_extract(before_v, rf"((?:{_NAME_WORD},?\s)*{_NAME_WORD})$", 1)
    defendant = F.regexp_extract(lead, r"(?s)^.*\s[Vv]s?\.?\s(.*?)[\s,]*$", 1)
    return without_signals(plaintiff), blank_to_null(F.trim(defendant))


def anchored_name(lead: Column, party: Column) -> Column:
    """The text from where the party's first long word stands last to the end: the name as the document has it, whatever the reading made of it."""
    word = blank_to_null(F.regexp_extract(party, _LONG_WORD, 1))
    from_word = F.call_function("regexp_extract", lead, F.concat(F.lit("(?is)^.*(?<![A-Za-z])("), word, F.lit(".*)$")), F.lit(1))
    return blank_to_null(F.regexp_replace(from_word, r"[\s,]+$", ""))


def fits_as_name(name: Column) -> Column:
    """Whether a text is a case name: not too long, of two parties, that read as names."""
    return F.coalesce((F.length(name) <= fixed.LONGEST_NAME) & sides(name).isNotNull() & is_plausible_party(name), F.lit(False))


def with_names(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_name`` (as written), ``name_source`` and ``name_note``.

    A name is the text from the anchor of its first party on; else the run of name
    words before the citation, within its sentence; else what the first reading
    made of the parties. Where the first reading differs from the name, a note says so.
    """
    plaintiff, defendant = parties_read(F.col("lead"))
    rows = rows.withColumns({"_plaintiff": plaintiff, "_defendant": defendant})
    read = F.concat("_plaintiff", F.lit(" v. "), "_defendant")
    rows = rows.withColumns({"_anchored": anchored_name(F.col("lead"), F.col("_plaintiff")), "_run": name_before(F.col("before")), "_read": read})
    is_case, found = F.col("kind") == "case", [("anchor", "_anchored"), ("pattern", "_run"), ("parties", "_read")]
    source = F.coalesce(*(F.when(is_case & fits_as_name(F.col(c)), F.lit(name)) for name, c in found))
    rows = rows.withColumn("name_source", source)
    rows = rows.withColumn("_name", F.coalesce(*(F.when(F.col("name_source") == name, F.col(c)) for name, c in found)))
    differs = F.col("name_source").isNotNull() & (one_line(F.col("_read")) != one_line(F.col("_name")))
    note = F.concat(F.lit("the parties were first read as '"), one_line(F.col("_read")), F.lit("'; the text has '"), one_line(F.col("_name")), F.lit("', which is used"))
    return rows.withColumn("name_note", F.when(differs, note)).drop("_plaintiff", "_defendant", "_anchored", "_run", "_read")


def citation_mentions(scanned: DataFrame) -> DataFrame:
    """One row per mention, read from what stands around it: bounded by its neighbours, never from beyond them. No document's text leaves its row."""
    rows = scanned.select("doc_id", F.posexplode("mentions").alias("pos", "m")).select("doc_id", "pos", "m.*")
    rows = rows.withColumns(
        {
            "_court": court_written(F.regexp_extract("after", fixed.YEAR_PARENTHESIS, 1)),
            "year": blank_to_null(F.regexp_extract("after", fixed.YEAR_PARENTHESIS, 2)),
            "_quote": F.regexp_extract(F.regexp_replace("after", fixed.YEAR_PARENTHESIS, ""), fixed.QUOTE_PARENTHESIS, 1),
        }
    )
    rows = with_names(rows.withColumn("parenthetical", F.when(F.col("year").isNotNull(), blank_to_null("_quote"))))
    rows = rows.withColumn("case_name", one_line("_name"))
    # As written: from the name, if there is one, to the parenthesis with the year.
    named = F.when(F.col("case_name").isNotNull(), F.concat(F.col("_name"), F.regexp_extract("lead", r"([\s,]*)$", 1)))
    rest = F.regexp_extract("rest", fixed.CITATION_END, 1)
    rows = rows.withColumn("verbatim", F.trim(one_line(F.concat(F.coalesce(named, F.lit("")), F.col("matched_text"), rest))))
    told = F.col("told")
    for pattern, court in COURTS.items():
        told = F.when(F.col("_court").rlike(pattern), F.lit(court)).otherwise(told)
    circuit = F.regexp_extract("_court", r"^([0-9]{1,2})(?:st|nd|rd|th) Cir", 1)
    rows = rows.withColumns(
        {
            "court": F.coalesce("_court", "told"),
            "court_id": F.when(circuit != "", F.concat(F.lit("ca"), circuit)).otherwise(told),
            "court_source": F.when(F.col("_court").isNotNull(), "document").when(F.col("told").isNotNull(), "reporter"),
            "cite_key": cite_key("volume", "reporter", "page"),
            "context": one_line("context"),
        }
    )
    return rows.drop("lead", "before", "after", "rest", "_court", "_quote", "_name")


def attribute_short_forms(mentions: DataFrame) -> DataFrame:
    """Each mention with ``target``, the position of the full citation that it repeats; full ones have their own.

    A short form repeats the citation of the same key, else the latest one before
    it in the same reporter, whatever the volume. Id. repeats the latest case.
    Supra and what finds nothing have none. Mentions are dealt by document once,
    which serves all windows.
    """
    mentions = mentions.repartition("doc_id")
    order = Window.partitionBy("doc_id").orderBy("s", "pos").rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("form") == "full"
    same_key = Window.partitionBy("doc_id", "cite_key").orderBy("s", "pos").rowsBetween(Window.unboundedPreceding, -1)
    same_reporter = Window.partitionBy("doc_id", "reporter").orderBy("s", "pos").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda condition, window: F.last(F.when(condition, F.col("pos")), ignorenulls=True).over(window)
    short = F.when(F.col("cite_key").isNotNull(), last(full, same_key))
    short = F.coalesce(short, F.when(F.col("reporter").isNotNull(), last(full, same_reporter)))
    target = F.when(full, F.col("pos")).when(F.col("form") == "short", short).when(F.col("form") == "id", last(full & (F.col("kind") == "case"), order))
    return mentions.withColumn("target", target)


def merge_authorities(mentions: DataFrame) -> DataFrame:
    """CITATION rows: one per authority of a document, in order of first mention.

    Full citations of one key, or without a key of one name, are one authority,
    described by its first; those with neither stay apart. Counts are summed and
    spans gathered, those of short forms too. Mentions are dealt by document once.
    """
    known = mentions.where("target is not null").repartition("doc_id")
    more = F.collect_list(F.when(F.col("form") != "full", F.struct("s", "e"))).over(Window.partitionBy("doc_id", "target"))
    full = known.withColumn("_spans", F.concat(F.array(F.struct("s", "e")), F.sort_array(more))).where("form = 'full'")
    own = F.coalesce("cite_key", blank_to_null(plain_name("case_name")), F.concat(F.lit("#"), F.col("pos").cast("string")))
    keyed = full.withColumn("_key", own)
    names = ["kind", "verbatim", "matched_text", "volume", "reporter", "page", F.col("pin").alias("pin_cite"), "court", "court_id", "court_source", "year", "case_name", "parenthetical", "cite_key", "context", "name_note"]
    first = F.min(F.struct("pos", *names)).alias("_first")
    merged = keyed.groupBy("doc_id", "_key").agg(first, F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_spans"))), lambda x: x["_spans"])).alias("spans"), F.count("*").alias("_rows"))
    idx = (F.row_number().over(Window.partitionBy("doc_id").orderBy("_first.pos")) - 1).cast("int")
    out = merged.select("doc_id", idx.alias("idx"), "_first.*", F.size("spans").alias("occurrence_count"), "spans")
    parts = sides("case_name")
    out = out.withColumns({"plaintiff": parts[0], "defendant": parts[1], "extraction_notes": F.array_compact(F.array("name_note"))})
    return out.select(*(x.split()[0] for x in CITATION.split(", ") if " " in x))


def extract_citations(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """CITATION rows of documents. Null, blank and citation-free documents have none."""
    return merge_authorities(attribute_short_forms(citation_mentions(scan_documents(docs, doc_id, text))))


def extraction_notes(mentions: DataFrame) -> DataFrame:
    """(doc_id, notes): what could not be attributed, and how many repeats were merged."""
    keys = F.coalesce("cite_key", blank_to_null(plain_name("case_name")), F.concat(F.lit("#"), F.col("pos").cast("string")))
    full = F.col("form") == "full"
    counts = mentions.groupBy("doc_id").agg(
        F.count_if((F.col("form") == "short") & F.col("target").isNull()).alias("lost"),
        F.count_if(F.col("form") == "supra").alias("supra"),
        (F.count_if(full) - F.count_distinct(F.when(full, keys))).alias("merged"),
    )
    say = lambda n, words: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(words)))
    notes = [say("lost", " short form(s) without a full citation"), say("supra", " supra reference(s) counted"), say("merged", " repeated citation(s) merged")]
    return counts.select("doc_id", F.array_compact(F.array(*notes)).alias("notes"))
