"""Declared schemas (DDL) of the stored tables and their additive history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CANDIDATE_DDL = (
    "struct<number:string,url:string,source:string,placement:string,evidence:string,"
    "page_url:string,note:string,broken:boolean>"
)
FINDING_DDL = (
    "struct<code:string,title:string,detail:string,evidence:array<string>,severity:string,param:int,capture:string>"
)
CHECK_DDL = "struct<ok:boolean,detail:string>"
SCORE_DDL = "struct<id:int,name:string,score:int,reason:string,evidence:array<string>,origin:string>"

SEARCHES = (
    "id long, query string, limit int, status string, phase string, businesses_found int, websites_found int, "
    "whatsapp_verified int, opportunities_found int, leads_found int, error string, created_at timestamp, finished_at timestamp"
)
BUSINESSES = (
    "id long, place_id string, google_maps_url string, business_name string, category string, phone_raw string, "
    "phone_e164 string, whatsapp_url string, whatsapp_status string, whatsapp_source string, whatsapp_evidence string, "
    f"whatsapp_candidates array<{CANDIDATE_DDL}>, whatsapp_multiple_numbers boolean, whatsapp_confidence string, "
    "whatsapp_broken_button boolean, whatsapp_check string, whatsapp_checked_at timestamp, discarded_at timestamp, "
    "discard_reason string, duplicate_of_id long, duplicate_reason string, website string, website_status string, "
    "instagram string, facebook string, address string, city string, commune string, opening_hours map<string,string>, "
    "rating double, review_count int, services array<string>, description string, field_sources map<string,string>, "
    "broken_web array<string>, first_seen_at timestamp, updated_at timestamp"
)
SEARCH_RESULTS = ("search_id long, business_id long, position int")
CONTACTED = (
    "id long, name string, phone_raw string, phone_e164 string, status string, contacted_on string, note string, imported_at timestamp"
)
FINGERPRINTS = ("id long, kind string, value string, business_id long, contacted_id long, created_at timestamp")
ANALYSES = (
    "id long, business_id long, url_analyzed string, final_url string, analyzed_at timestamp, rubric_version string, "
    f"model_name string, website_score int, rubric_scores map<string,{SCORE_DDL}>, facts string, findings array<{FINDING_DDL}>, "
    f"seo_local map<string,{CHECK_DDL}>, info_checklist map<string,{CHECK_DDL}>, main_problems array<string>, "
    "opportunities array<string>, strengths array<string>, opportunity_level string, screenshots map<string,string>, "
    "load_time_ms int, psi_mobile_score int, raw_output string, error string"
)
PLACE_CARDS = (
    "run_id long, position int, name string, url string, card_seen boolean, website string, phone_e164 string"
)
TABLES = {
    "searches": SEARCHES, "businesses": BUSINESSES, "search_results": SEARCH_RESULTS,
    "contacted_leads": CONTACTED, "fingerprints": FINGERPRINTS, "website_analyses": ANALYSES,
}

# Columns added by schema versions 2 to 5, with the value older rows get.
ADDED_COLUMNS = {
    "businesses": {
        2: {"whatsapp_confidence": None, "whatsapp_broken_button": False},
        3: {"whatsapp_check": None, "whatsapp_checked_at": None, "discarded_at": None, "discard_reason": None},
        5: {"duplicate_of_id": None, "duplicate_reason": None},
    },
    "searches": {3: {"leads_found": 0}},
    "website_analyses": {4: {"findings": []}},
}


def upgrade(df: DataFrame, table: str) -> DataFrame:
    """Bring a snapshot of any earlier schema version to the current one: missing columns get their default."""
    schema = T.StructType.fromDDL(TABLES[table])
    defaults = {name: value for version in ADDED_COLUMNS.get(table, {}).values() for name, value in version.items()}
    columns = []
    for field in schema.fields:
        default = defaults.get(field.name)
        missing = F.array() if default == [] else F.lit(default)
        if field.name not in df.columns:
            columns.append(missing.cast(field.dataType).alias(field.name))
        elif default is not None:
            columns.append(F.coalesce(F.col(field.name), missing.cast(field.dataType)).alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)
