"""Header maps: scrubbing, look-ups and the trust gate for target overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.rules.routing import LOOPBACK_PEERS, SENSITIVE_HEADERS


def header(headers: Column, name: str) -> Column:
    """Value of a lower-case header name; null when absent or empty."""
    return F.nullif(F.try_element_at(headers, F.lit(name)), F.lit(""))


def scrub_headers(headers: Column) -> Column:
    """The map without sensitive names (any case) and without null values."""
    return F.map_filter(
        headers, lambda k, v: ~F.lower(k).isin(*SENSITIVE_HEADERS) & v.isNotNull()
    )


def scrub_table(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: scrub_headers(F.col(c)) for c in columns})


def trusted_headers(headers: Column, peer: Column, allow_override: bool) -> Column:
    """Headers for target resolution: ``x-target-url`` counts only from a loopback peer."""
    local = F.coalesce(peer.isin(*LOOPBACK_PEERS), F.lit(False))
    trusted = local if allow_override else F.lit(False)
    dropped = F.map_filter(headers, lambda k, v: k != "x-target-url")
    return F.when(trusted | header(headers, "x-target-url").isNull(), headers).otherwise(dropped)
