from freightlens.operators.bins import bin_column, label_rank
from freightlens.operators.correlation import lead_corr, pearson_ranked, pearson_wide
from freightlens.operators.events import next_event_after, transition_events
from freightlens.operators.exact import Mean, Rows, exact_aggregate, exact_deviation, mean, share
from freightlens.operators.features import feature_set
from freightlens.operators.ntile import exact_ntile
from freightlens.operators.order_stats import group_quantiles
from freightlens.operators.outliers import (
    excursion_association,
    iqr_outliers,
    sigma_excursions,
    value_summary,
)
from freightlens.operators.profiles import (
    cross_profile,
    group_profile,
    mean_of_period_means,
    period_union,
    share_where,
)
from freightlens.operators.quality import quality_profile
from freightlens.operators.row_search import rows_at_ranks
from freightlens.operators.ranking import capacity_windows, top_ranked
from freightlens.operators.timeseries import lag_features, rolling_rows_mean, seasonal_forecast

__all__ = [
    "Mean",
    "Rows",
    "bin_column",
    "capacity_windows",
    "cross_profile",
    "exact_aggregate",
    "exact_deviation",
    "exact_ntile",
    "excursion_association",
    "feature_set",
    "group_profile",
    "group_quantiles",
    "iqr_outliers",
    "label_rank",
    "lag_features",
    "lead_corr",
    "mean",
    "mean_of_period_means",
    "next_event_after",
    "pearson_ranked",
    "pearson_wide",
    "period_union",
    "quality_profile",
    "rolling_rows_mean",
    "rows_at_ranks",
    "seasonal_forecast",
    "share",
    "share_where",
    "sigma_excursions",
    "top_ranked",
    "transition_events",
    "value_summary",
]
