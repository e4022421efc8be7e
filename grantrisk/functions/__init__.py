from grantrisk.functions.scalar import (  # noqa: F401
    day_diff, decimal_comma_to_double, double_to_decimal_comma, fill_missing_expr,
    fill_zero_expr, fmt3, mix, parse_date, repair_separators, share, uniform01, value_band,
)
