"""Types of the tables, as DDL strings."""

RECORD = "struct<cluster_id:bigint,case_name:string,citations:array<string>,court:string,date_filed:string,absolute_url:string,snippet:string>"
RAW_RECORD = (
    "struct<cluster_id:bigint,caseName:string,caseNameFull:string,citation:array<string>,court_citation_string:string,court:string,"
    "dateFiled:string,absolute_url:string,opinions:array<struct<snippet:string>>>"
)
CITATION = (
    "doc_id string, idx int, kind string, verbatim string, matched_text string, volume string, reporter string, page string, pin_cite string, court string, "
    "court_id string, court_source string, year string, case_name string, plaintiff string, defendant string, parenthetical string, cite_key string, "
    "spans array<struct<s:int,e:int>>, occurrence_count int, context string, extraction_notes array<string>"
)
EVIDENCE = f"struct<strategy:string,query:string,result_count:int,matched:boolean,top:{RECORD},note:string>"
OVERALL = f"struct<found:int,sim:double,rec:{RECORD},citations:array<string>,courts:array<string>>"
RESULTS = f"doc_id string, idx int, strategy string, rank int, rec {RECORD}, sim double, lists boolean, found int"
STATUS = "doc_id string, idx int, strategy string, error string"
EXPECTED = "array<struct<citation_verbatim:string,case_name:string,volume:string,reporter:string,page:string,court:string,year:string,verdict:string,error_class:string,slot_occupied_by:string,source_url:string,notes:string>>"
FIXTURE = f"id string, title string, source_url string, provenance string, text string, expected {EXPECTED}"
REPLY = "support string, confidence double, rationale string, passage string"
