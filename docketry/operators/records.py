"""Case records: from a corpus's loose replies to fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import blank_to_null, normalized
from docketry.functions.schemas import RAW_RECORD, RECORD


def record_of(raw: Column, site: str = "") -> Column:
    """A RECORD from a RAW_RECORD: the fuller name, the written court, the snippet on one line, a whole URL."""
    url = raw["absolute_url"]
    return F.struct(
        raw["cluster_id"].alias("cluster_id"),
        F.trim(F.coalesce(blank_to_null(raw["caseNameFull"]), blank_to_null(raw["caseName"]), F.lit(""))).alias("case_name"),
        F.coalesce(raw["citation"], F.array().cast("array<string>")).alias("citations"),
        F.coalesce(blank_to_null(raw["court_citation_string"]), blank_to_null(raw["court"])).alias("court"),
        blank_to_null(raw["dateFiled"]).alias("date_filed"),
        F.when(url.startswith("/"), F.concat(F.lit(site), url)).otherwise(url).alias("absolute_url"),
        blank_to_null(normalized(F.get(raw["opinions"], F.lit(0))["snippet"])).alias("snippet"),
    ).cast(RECORD)


def parsed_reply(payload: Column) -> Column:
    """RAW_RECORDs of a JSON reply; a citation may be one string. Malformed replies give null."""
    one = RAW_RECORD.replace("citation:array<string>", "citation:string")
    several = F.from_json(payload, f"results array<{RAW_RECORD}>", {"mode": "PERMISSIVE"})["results"]
    single = F.from_json(payload, f"results array<{one}>", {"mode": "PERMISSIVE"})["results"]
    own = lambda r, i: F.coalesce(F.get(several, i)["citation"], F.when(~r["citation"].startswith("["), F.array(r["citation"])))
    return F.transform(single, lambda r, i: r.withField("citation", own(r, i))).cast(f"array<{RAW_RECORD}>")


def case_citations(cases: DataFrame) -> DataFrame:
    """(cite_key, cluster_id): one row per distinct citation that a case lists. Cases without an id or citations give none."""
    from docketry.functions.text import reporter_key

    rows = cases.where("cluster_id is not null").select("cluster_id", F.explode("citations").alias("_c"))
    return rows.select(reporter_key("_c").alias("cite_key"), "cluster_id").where("cite_key <> ''").distinct()


def opinion_texts(opinions: DataFrame, most: int, longest: int) -> DataFrame:
    """(cluster_id, full_text): the first ``most`` opinions' texts of each case, parted by an empty line.

    Of an opinion's fields the first that isn't empty counts, cut at ``longest``
    and without markup. Cases without any text give no row.
    """
    from docketry.functions.text import without_markup

    fields = ("plain_text", "html_with_citations", "html", "html_lawbox", "xml_harvard")
    body = F.coalesce(*(blank_to_null(c) for c in fields))
    rows = opinions.where(F.col("cluster_id").isNotNull() & (F.col("ord") < most)).select("cluster_id", "ord", "opinion_id", without_markup(F.substring(body, 1, longest)).alias("_t"))
    rows = rows.where("_t is not null").groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("ord", "opinion_id", "_t"))).alias("_all"))
    return rows.select("cluster_id", F.array_join(F.transform("_all", lambda x: x["_t"]), "\n\n").alias("full_text"))
