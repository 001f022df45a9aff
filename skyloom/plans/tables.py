"""The catalog's published tables: columns, keys, checks and references."""

from __future__ import annotations

from skyloom.sources.published import Table

NOW = "current_timestamp()"


def made(text: str, key: str = "id", checks: tuple[str, ...] = (), refers: dict[str, tuple[str, str, str]] | None = None, stamp: str = "created_at", **defaults: str) -> Table:
    """A table from lines of a type and its columns. A column that is `?` may be null; the stamp's default is the time of writing."""
    columns = {c: kind + ("?" if c.endswith("?") else "") for line in text.strip().split("\n") for kind, *names in [line.split()] for c in names}
    columns = {c.rstrip("?"): t for c, t in columns.items()} | ({stamp: "string"} if stamp else {})
    return Table(columns, key, checks, ({stamp: NOW} if stamp else {}) | defaults, refers or {})


RUN = {"catalog_run_id": ("catalog_runs", "id", "cascade")}
RECORD = RUN | {"lounge_id": ("lounge_records", "id", "cascade")}
OF_TARGET = {"source_id": ("source_targets", "id", "refuse")}

# Names and types of the published columns.
TABLES = {
    "coverage_goals": made(
        """string id version title status target_scope
int target_approved_records
double target_approved_ratio target_source_family_ratio
int max_unknown_airport_records max_records_without_sources max_records_without_quality
string updated_at notes_json""",
        checks=("status IN ('draft', 'active', 'complete', 'retired')",), updated_at=NOW, notes_json="'{}'",
    ),
    "catalog_runs": made(
        """string id generated_at catalog_hash
int total_records approved_records review_records candidate_records non_priority_records unique_airports unique_countries
string source_families_json quality_json""",
    ),
    "lounge_records": made(
        """string id catalog_run_id name brand operator category status airport_iata airport_name city country
double latitude longitude
string terminal review_status
int completeness freshness source_count
string programs_json access_methods_json conflicts_json canonical_json""",
        refers=RUN,
    ),
    "lounge_sources": made(
        """bigint id
string lounge_id catalog_run_id source_id publisher url retrieved_at
double confidence
string field_coverage_json rights_note""",
        refers=RECORD, stamp="",
    ),
    "lounge_field_coverage": made(
        """bigint id
string lounge_id catalog_run_id name brand airport_iata airport_name city country source_id publisher source_url retrieved_at review_status
int has_hours has_gate has_price
string hours_text gate_text price_offers_json field_coverage_json""",
        checks=("has_hours IN (0, 1)", "has_gate IN (0, 1)", "has_price IN (0, 1)"), refers=RECORD,
    ),
    "source_runs": made("string id generated_at policy_json stats_json sources_json"),
    "source_targets": made(
        """string id publisher adapter status url
int freshness_days required_for_terminal
string source_family_ids_json rights_note target_json""",
        checks=("required_for_terminal IN (0, 1)",), stamp="updated_at",
    ),
    "airport_authority": made(
        """string iata icao name city country country_code timezone
double latitude longitude
string source_id source_airport_id authority_json""",
        key="iata", stamp="updated_at",
    ),
    "source_fetch_runs": made(
        """string id source_id run_id generated_at runtime fetch_mode status url final_url
int http_status?
string content_type
bigint bytes
string sha256
int records airport_code_count lounge_link_count cloudflare_snapshot
string reason attempts_json""",
        checks=("cloudflare_snapshot IN (0, 1)",), refers=OF_TARGET,
    ),
    "source_snapshots": made(
        """string id source_id run_id snapshot_uri url final_url sha256
bigint bytes
string retrieved_at storage
int raw_content_committed""",
        checks=("raw_content_committed IN (0, 1)",), refers=OF_TARGET,
    ),
    "source_parse_runs": made(
        """string id source_id run_id generated_at parser_version status
int extracted_records rejected_records
string airport_codes_json lounge_links_json structured_records_json""",
        refers=OF_TARGET,
    ),
    "source_candidates": made(
        """string id catalog_run_id source_id canonical_lounge_id? name brand airport_iata airport_name city country status review_status
int completeness
double confidence
string candidate_json""",
        refers=RUN | {"canonical_lounge_id": ("lounge_records", "id", "null")},
    ),
    "lounge_identity_links": made(
        """string id catalog_run_id canonical_lounge_id linked_lounge_id source_id match_reason
double confidence
int conflict_count
string evidence_json""",
        refers=RUN | {"canonical_lounge_id": ("lounge_records", "id", "cascade")},
    ),
    "record_field_evidence": made(
        """string id catalog_run_id lounge_id field_group field_name field_path
int has_value
string value_text source_id publisher source_url
double confidence
string retrieved_at missing_reason evidence_json""",
        checks=("has_value IN (0, 1)",), refers=RECORD,
    ),
    "review_queue": made("string id catalog_run_id lounge_id issue_type field_path status severity source_id reason opened_at resolved_at? payload_json", refers=RECORD),
    "coverage_validation_runs": made(
        "string id coverage_goal_id catalog_run_id? status summary_json blockers_json",
        checks=("status IN ('passed', 'failed')",), refers={"coverage_goal_id": ("coverage_goals", "id", "refuse"), "catalog_run_id": ("catalog_runs", "id", "refuse")},
    ),
}
