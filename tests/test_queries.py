"""Registered queries against DuckDB on the smallest tables; tests/compare.py runs them all."""

import pytest

from tallyspark.testbed import registered

SF = "/root/testdata/sf0.001"
CHECKED = [
    "a01_derive_rate_card", "a03_ledger_totals", "a05_spend_by_model", "a05_spend_by_model_sliced", "a07_spend_by_cost_centre",
    "a09_workspace_stats", "a10_project_tree", "a15_hud_history", "a21_question_duplication", "a25_rollup_teams", "a27_spend_distribution",
    "c09_simulation_report", "d01_w1_tool_definition_tax", "d04_w4_session_staleness", "e02_assess_balance", "f13_resolve_allowance",
    "j04_rereads", "j15_verify_settings", "o01_measure_durability", "o08_two_way_fixed_effects", "r03_payload_alerts",
    "s03_split_lines", "s14_git_files", "s16_read_otel_spans", "s17_read_roster", "v09_kaplan_meier", "v11_log_rank",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_duckdb(spark, name):
    from compare import compare, oracle_connection

    registry = registered()
    ok, note, _ = compare(spark, oracle_connection(SF), name, registry.QUERIES[name], registry.ORACLES[name], SF)
    assert ok, note


def test_registration_needs_no_session_and_is_complete():
    registry = registered()
    assert len(registry.QUERIES) > 150
    assert set(registry.ORACLES) <= set(registry.QUERIES)
