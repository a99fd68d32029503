"""Masking whole tables from a column-to-strategy configuration."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import masking as m

# Which columns of which extract are masked, and how.
MASKED_COLUMNS = {
    "patients": {
        "first_name": "pseudonymize",
        "last_name": "pseudonymize",
        "full_name": "pseudonymize",
        "ssn": "mask_ssn",
        "phone": "mask_phone",
        "address": "mask_address",
        "email": "mask_email",
        "date_of_birth": "generalize_year",
    },
    "admissions": {"attending_physician_name": "pseudonymize"},
    "notes": {"note_text": "scrub_freetext"},
}


def strategies(key: bytes) -> dict[str, Callable[[str], Column]]:
    return {
        "pseudonymize": lambda c: m.pseudonymize(c, key),
        "mask_ssn": m.mask_ssn,
        "mask_phone": m.mask_phone,
        "mask_address": m.mask_address,
        "mask_email": m.mask_email,
        "generalize_year": m.generalize_year,
        "scrub_freetext": m.scrub_text,
    }


def mask_table(df: DataFrame, config: Mapping[str, str], key: bytes) -> DataFrame:
    """Mask the configured columns; absent columns are skipped, an unknown strategy is an error."""
    known = strategies(key)
    for column, strategy in config.items():
        if column in df.columns and strategy not in known:
            raise ValueError(f"Unknown masking strategy '{strategy}' for column '{column}'.")
    masked = {c: known[s](c) for c, s in config.items() if c in df.columns}
    return df.withColumns(masked) if masked else df


def mask_audit(df: DataFrame, table: str, config: Mapping[str, str]) -> DataFrame:
    """How many values each strategy touches, never the values, from one aggregation."""
    present = {c: s for c, s in config.items() if c in df.columns}
    one = df.agg(*[F.count(c).alias(c) for c in present])
    rows = [
        F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.lit(s).alias("strategy"), F.col(c).alias("masked"))
        for c, s in present.items()
    ]
    return one.select(F.inline(F.array(*rows)))
