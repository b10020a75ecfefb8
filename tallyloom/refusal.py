"""Typed refusals: what the engine says instead of a number that would be silently wrong."""

from __future__ import annotations

#: The codes of a refused question.
QUESTION_CODES = (
    "metric_unknown", "too_many_metrics", "duplicate_metric_name", "grain_not_supported", "dimension_not_permitted",
    "dimension_not_conformed", "dimension_not_filterable", "dimension_value_not_allowed", "duplicate_dimension",
    "too_many_dimensions", "too_many_filters", "result_too_large", "time_range_too_long", "plan_spans_too_many_sources",
    "question_needs_too_many_legs", "plan_needs_too_many_lookup_legs", "federation_not_executable",
    "federation_link_type_mismatch", "plan_tables_share_an_identifier",
    "source_unavailable", "resources_exhausted", "deadline_exceeded", "budget_exhausted",
    "cross_model_ratio_without_shared_calendar", "cross_model_ratio_without_shared_dimension", "cross_model_ratio_link_ambiguous",
)
#: Why a federated answer is not well formed.
FEDERATED_CODES = ("non_finite", "float_link_key", "ambiguous_link", "link_type_mismatch", "link_kinds_not_joined", "link_value_not_cast", "non_numeric_leaf", "bucket_kind_mismatch", "key_kind_mismatch")
#: Codes that a plan raises inside a column, while it runs.
ALARMS = ("cross_model_ratio_link_ambiguous", "ambiguous_link", "link_value_not_cast", "non_finite")
#: Codes of a refused statement, of a refused catalog and of a refused file.
STATEMENT_CODES = ("statement_too_long", "not_read_only", "construct_not_allowed", "unknown_table", "recursive_cte", "table_function", "expression_too_large", "select_without_table", "too_many_rows", "too_many_sources", "exists_in_projection")
CATALOG_CODES = ("invalid_definition", "unknown_reference", "name_collision", "unsupported_codec", "declared_key_not_unique", "anchor_mismatch", "expression_refused", "text_policy_refused", "missing_table")


class Refusal(Exception):
    """`code` is one of the lists above; `detail` names what was asked, never a value that was not declared."""

    def __init__(self, code: str, detail: str = ""):
        assert code in QUESTION_CODES + FEDERATED_CODES + STATEMENT_CODES + CATALOG_CODES, code
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code, self.detail = code, detail
