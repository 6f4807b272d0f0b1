from runscope.functions.scalar import (
    array_distance,
    cluster_label,
    distance,
    finite,
    not_nan,
    outlier_label,
    parse_number,
    rank_opacity,
    scale_position,
    signal_group,
    signal_variable,
)

__all__ = [
    "array_distance",
    "cluster_label",
    "distance",
    "finite",
    "not_nan",
    "outlier_label",
    "parse_number",
    "rank_opacity",
    "scale_position",
    "signal_group",
    "signal_variable",
]
