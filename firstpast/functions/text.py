"""Text columns: brands, labels, addresses, hosts and ping output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source-name prefix -> brand, first match wins.
BRAND_PREFIXES = (
    ("everstake", "everstake"),
    ("lucky", "lucky-stake"),
    ("twinstake", "twinstake"),
    ("jupiter", "jupiter"),
    ("thor", "thor"),
    ("dawn", "dawn-labs"),
    ("assymetric", "asymmetric"),
    ("asymmetric", "asymmetric"),
    ("staking-fac", "staking-facilities"),
    ("p2p", "p2p.org"),
    ("jito", "jito"),
    ("soyas", "soyas"),
    ("soldiver", "soldiver"),
)
# Brands without a report of their own.
UNREPORTED_BRANDS = ("other", "jito")

# Base58 identity key of 32 bytes.
IDENTITY_KEY = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def brand_of(source: str | Column, prefixes: Sequence[tuple[str, str]] = BRAND_PREFIXES,
             default: str = "other") -> Column:
    """Brand of a source name by its first matching prefix, ignoring case."""
    name = F.lower(_col(source))
    (prefix, brand), *rest = prefixes
    chain = F.when(F.startswith(name, F.lit(prefix)), brand)
    for prefix, brand in rest:
        chain = chain.when(F.startswith(name, F.lit(prefix)), brand)
    return chain.otherwise(default)


def label(col: str | Column, labels: Mapping[str, str]) -> Column:
    """Replace known values by their label; others stay as they are."""
    column = _col(col)
    if not labels:
        return column
    pairs = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, column), column)


# Prefixes of names that hold an address. Fixed values.
ADDRESSED = ("fra", "ny")


def ip_in_name(source: str | Column) -> Column:
    """The address in names like ``fra-1.2.3.4`` and ``ny-1.2.3.4``, else NULL."""
    column = _col(source)
    candidate = F.substring_index(column, "-", 1)
    rest = column.substr(F.length(candidate) + 2, F.length(column))
    dots = F.length(rest) - F.length(F.replace(rest, F.lit("."), F.lit("")))
    return F.when(candidate.isin(*ADDRESSED) & F.contains(column, F.lit("-")) & (dots == 3), rest)


def host_of(url: str | Column) -> Column:
    """Host of an endpoint: scheme, path, query and a numeric port removed."""
    rest = F.element_at(F.split(_col(url), "://"), -1)
    authority = F.element_at(F.split(rest, "[/?]"), 1)
    host = F.trim(F.regexp_replace(authority, "^(.+):[0-9]*$", "$1"))
    return F.when(host != "", host)


def strip_port(endpoint: str | Column) -> Column:
    """Everything before the last colon."""
    return F.regexp_replace(_col(endpoint), ":[^:]*$", "")


def avg_rtt(ping_output: str | Column) -> Column:
    """Average round trip of a ping summary (second field of min/avg/max)."""
    field = F.regexp_extract(
        _col(ping_output), r"(?m)^[^=\n]*min/avg/max[^=\n]*=\s*[^/\s]+/([^/\s=]+)", 1)
    return F.trim(field).try_cast("double")


def probe_rtt(ping_output: str | Column) -> Column:
    """Round trip of a single probe (its ``time=`` token)."""
    return F.regexp_extract(_col(ping_output), r"(?:^|\s)time=(\S+)", 1).try_cast("double")


def is_identity_key(col: str | Column) -> Column:
    return _col(col).rlike(IDENTITY_KEY)


def location_of(city: str | Column, country: str | Column) -> Column:
    """``city, country`` without a dangling separator."""
    joined = F.concat(F.coalesce(_col(city), F.lit("")), F.lit(", "), F.coalesce(_col(country), F.lit("")))
    return F.btrim(joined, F.lit(", "))


def sheet_name(name: str | Column) -> Column:
    """A report name, cut to 31 characters."""
    return F.left(_col(name), F.lit(31))


def grouped_int(n: str | Column) -> Column:
    """Thousands separators."""
    return F.format_number(_col(n), 0)


def utc_iso(t: str | Column) -> Column:
    return F.date_format(_col(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_compact(t: str | Column) -> Column:
    return F.date_format(_col(t), "yyyyMMdd'T'HHmmss'Z'")
