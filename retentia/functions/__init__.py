"""Column-level helpers with PostgreSQL-compatible semantics."""

from retentia.functions.scalar import (
    avg_of, date_days_between, epoch_days_between, extract_days_between, micros_between,
    money, nullif_blank, pct, percentile_from_histogram, pg_concat_ws, pg_initcap, ratio,
    round_half,
)

__all__ = [
    "avg_of", "date_days_between", "epoch_days_between", "extract_days_between",
    "micros_between", "money", "nullif_blank", "pct", "percentile_from_histogram",
    "pg_concat_ws", "pg_initcap", "ratio", "round_half",
]
