from churnscope.operators.audit import (
    distinct_values,
    duplicate_groups,
    fd_violations,
    invalid_measure_count,
    missing_match_count,
    missing_matches,
    null_key_rows,
    orphan_keys,
    preview,
    row_counts,
)
from churnscope.operators.cleaning import dedup_keep_first, fd_map, impute_key_by_fd, valid_measures
from churnscope.operators.metrics import (
    group_gap,
    latest_by_date,
    latest_per_key,
    mean_elapsed_by_group,
    rate_by_group,
    split_rate_by_group,
)
from churnscope.operators.quality import quality_report

__all__ = [
    "dedup_keep_first",
    "distinct_values",
    "duplicate_groups",
    "fd_map",
    "fd_violations",
    "group_gap",
    "impute_key_by_fd",
    "invalid_measure_count",
    "latest_by_date",
    "latest_per_key",
    "mean_elapsed_by_group",
    "missing_match_count",
    "missing_matches",
    "null_key_rows",
    "orphan_keys",
    "preview",
    "quality_report",
    "rate_by_group",
    "row_counts",
    "split_rate_by_group",
    "valid_measures",
]
