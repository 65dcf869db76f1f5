from cohortlens.functions.common import safe_div, pct, floor_days, round_half_up, round_half_even
from cohortlens.functions.stats import (
    norm_cdf, norm_ppf, t_sf, wilson_bounds, newcombe_diff_ci, proportion_effectsize,
)

__all__ = [
    "safe_div", "pct", "floor_days", "round_half_up", "round_half_even",
    "norm_cdf", "norm_ppf", "t_sf", "wilson_bounds", "newcombe_diff_ci", "proportion_effectsize",
]
