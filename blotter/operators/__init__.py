"""Operators on incident-like tables."""

from blotter.operators.clean import (
    columns_of_type,
    completeness_report,
    drop_incomplete,
    features_label,
    fill_const,
    fill_incidents,
    normalize_names,
    null_flags,
    require_not_null,
    type_incidents,
)
from blotter.operators.counts import (
    column_totals,
    count_by,
    count_vs_mean,
    distinct_count,
    distinct_values,
    shape,
    share_of_total,
    top_n,
)
from blotter.operators.crosstab import (
    clip_symmetric,
    crosstab,
    crosstab_dense,
    crosstab_wide,
    daily_counts,
    hour_by,
    melt,
    minmax_within,
    on_all_days,
    rolling_on_all_days,
    rolling_runs,
    rolling_sum,
    top_columns_matrix,
    transpose,
    weekday_by,
    weekday_by_hour,
    zscore_within,
)
from blotter.operators.enrich import enrich_lookup
from blotter.operators.hotspots import hotspots, location_counts
from blotter.operators.ordered import exact_quantiles, running_totals
from blotter.operators.profile import corr_matrix, density, describe, histogram, profile
from blotter.operators.rates import flag_count, flag_pivot, flag_rate, flag_trend, outer_counts
from blotter.operators.timeparts import (
    count_by_month,
    count_by_part,
    count_by_weekday,
    monthly_counts,
    time_parts,
)
from blotter.operators.topk import (
    argmax_per_group,
    bucket_other,
    top_k_columns,
    top_k_per_group,
)

__all__ = [name for name in dir() if not name.startswith("_")]
