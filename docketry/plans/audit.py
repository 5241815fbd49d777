"""The audit from documents to reports, as one plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from docketry.operators.corpus import Corpus
from docketry.operators.extract import attribute_short_forms, citation_mentions, extraction_notes, merge_authorities, scan_documents
from docketry.operators.reports import audit_reports, report_notes
from docketry.operators.search import corpus_search, replay_search
from docketry.operators.verdicts import decided_rows, explain_verdicts
from docketry.sources.shared import discard, scratch, stage


class Audit(NamedTuple):
    citations: DataFrame
    findings: DataFrame
    reports: DataFrame
    staged: tuple[DataFrame, ...]

    def discard(self) -> None:
        """Delete what the audit has staged, once its results are written."""
        discard(*self.staged)


def audit(documents: DataFrame, cases: DataFrame | Corpus | None = None, replies: DataFrame | None = None, strict: bool = False, doc_id: str = "doc_id", text: str = "text") -> Audit:
    """Audit ``documents`` against a table of cases, a kept corpus, or stored replies.

    Give ``cases`` (see ``corpus_search``) or ``replies`` (see ``replay_search``).
    Documents are scanned once: mentions, citations and what is decided are written
    to the shared folder, and the results read them; what searches stage on the way
    is deleted at the end. Documents without citations have a report with zeros.
    """
    with scratch() as keep:
        mentions = keep(stage(attribute_short_forms(citation_mentions(scan_documents(documents, doc_id, text))), "mentions"))
        citations = keep(stage(merge_authorities(mentions), "citations"))
        checked = citations.where("kind = 'case'")
        results, status = corpus_search(checked, cases) if cases is not None else replay_search(checked, replies)
        decided = keep(decided_rows(checked, results if status is None else stage(results, "results"), status, strict))
    found = explain_verdicts(decided)
    reports = audit_reports(documents, found, citations.where("kind <> 'case'"), doc_id)
    return Audit(citations, found, report_notes(reports, extraction_notes(mentions)), (mentions, citations, decided))
