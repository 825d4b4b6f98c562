from freightlens.functions.calendar import day, hour_of_day, weekday_from_zero, whole_hours
from freightlens.functions.numeric import round_half_up, rounded, share
from freightlens.functions.pearson import pearson_centred, pearson_moments, pearson_pairwise

__all__ = [
    "day",
    "hour_of_day",
    "pearson_centred",
    "pearson_moments",
    "pearson_pairwise",
    "round_half_up",
    "rounded",
    "share",
    "weekday_from_zero",
    "whole_hours",
]
