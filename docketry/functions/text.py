"""Text as Column expressions: white space, keys, quotations, courts, dates, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions import fixed


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# The same as fixed.SPACE, which asks a dozen ranges for each letter, after one that rules out what is printed in ASCII.
_SPACE = rf"[[^!-~]&&{fixed.SPACE}]"
_UNEVEN = rf"[[^ -~]&&{fixed.SPACE}]|  "


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once. A Column that is used twice is worked out twice wherever Spark does not see that both are the same, as inside of lambdas and conditions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(x) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(_c(x), F.lit(""))


def one_line(x) -> Column:
    """Each run of white space as one space; the ends are kept. Most texts have single spaces only and stay as they are."""
    return bound(_c(x), lambda text: F.when(text.rlike(_UNEVEN), F.regexp_replace(text, f"{_SPACE}+", " ")).otherwise(text))


def normalized(x) -> Column:
    """One line without spaces at its ends; null is empty. All spans count from this form of a document."""
    return F.trim(one_line(F.coalesce(_c(x), F.lit(""))))


def reporter_key(x) -> Column:
    """A written citation in a form that spacing, case, stops and commas don't change."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(_c(x), F.lit(""))), f"{_SPACE}+", ""), ".,", "")


def cite_key(volume, reporter, page) -> Column:
    """The key of a citation's parts, null unless it has all three."""
    parts = [blank_to_null(p) for p in (volume, reporter, page)]
    return F.when(F.array_size(F.array_compact(F.array(*parts))) == 3, reporter_key(F.concat(*parts)))


def lists_key(citations, key) -> Column:
    """Whether one of the citations of a record has the key."""
    return F.coalesce(F.exists(F.coalesce(_c(citations), F.array().cast("array<string>")), lambda c: reporter_key(c) == _c(key)), F.lit(False))


def comparable_quote(x) -> Column:
    """Quoted words without quotation marks, ellipses, insertions in brackets, punctuation and case."""
    bare = F.regexp_replace(F.translate(F.coalesce(_c(x), F.lit("")), "“”‘’\"'…", "       "), r"\.\.\.", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\[[^\]]*\]", " "), r"[^A-Za-z0-9]+", " ")
    return F.lower(F.trim(bare))


def word_count(x) -> Column:
    """Words of a text whose words are parted by single spaces."""
    return F.when(_c(x) == "", 0).otherwise(F.size(F.split(_c(x), " ")))


def is_distinctive(x) -> Column:
    """Whether a quotation is long enough to be looked for among all opinions."""
    bare = comparable_quote(x)
    return (F.length(bare) >= fixed.QUOTE_CHARS) & (word_count(bare) >= fixed.QUOTE_WORDS)


def court_token(x, strict: bool = False) -> Column:
    """A court's name or id in a comparable form; null is empty.

    ``11th Cir.`` becomes ``ca11``. ``2d`` and ``3d`` stay as written unless ``strict``.
    """
    bare = F.translate(F.lower(F.coalesce(_c(x), F.lit(""))), ". ", "")
    numbered = F.regexp_replace(bare, f"(?s)^([0-9]{{1,2}})(?:st|nd|rd|th{'|d' if strict else ''})cir.*$", "ca$1")

    def known(court):
        out = court
        for written, other in fixed.COURT_ALIASES.items():
            out = F.when(court == written, F.lit(other)).otherwise(out)
        return out

    return bound(numbered, known)


def year_in(x) -> Column:
    """The first year from 1900 to 2099 in a text, else null."""
    return blank_to_null(F.regexp_extract(_c(x), "((?:19|20)[0-9]{2})", 1))


def without_markup(x) -> Column:
    """Text without tags. Runs of blanks become one, breaks between paragraphs stay."""
    out = F.translate(F.regexp_replace(F.regexp_replace(_c(x), "<[^>]+>", " "), "\r\n", "\n"), "\r", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\f\x0B]+", " "), " *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), rf"^{fixed.SPACE}+|{fixed.SPACE}+$", "")


def court_written(x) -> Column:
    """What a parenthesis says of the court: without a month, a day and commas at its end; null if nothing is left."""
    out = F.trim(F.regexp_replace(F.trim(_c(x)), ",+$", ""))
    for end in (r"\s+[0-9]{1,2}\s*,?\s*$", r"\s*,?\s*$"):
        out = F.regexp_replace(out, fixed.MONTH + end, "")
    return blank_to_null(F.trim(F.regexp_replace(F.trim(out), ",+$", "")))


def table_cell(x) -> Column:
    """Text for a cell of a Markdown table."""
    return F.trim(F.replace(F.replace(F.coalesce(_c(x), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def request_key(method, url, body) -> Column:
    """The key under which a reply is stored."""
    return F.sha2(F.concat_ws("\n", _c(method), _c(url), F.coalesce(_c(body), F.lit(""))), 256)


def retry_after(header) -> Column:
    """Seconds to wait by a reply's header: half a second at least, 36 without a number."""
    return F.greatest(F.lit(0.5), F.coalesce(F.expr("try_cast(`%s` AS double)" % header) if isinstance(header, str) else header.try_cast("double"), F.lit(36.0)))


def percent(part, whole) -> Column:
    """100 part / whole to one digit, half to even; null if there is no whole."""
    return F.bround(F.try_divide(F.lit(100.0) * _c(part), F.nullif(_c(whole), F.lit(0))), 1)


def ratio(part, whole, digits: int = 4) -> Column:
    return F.bround(F.try_divide(_c(part).cast("double"), F.nullif(_c(whole), F.lit(0))), digits)
