"""Description cleaning (C1–C7) and the dialect-B display merchant (P7), as
native column expressions: every step is a ``regexp_replace`` / ``btrim``
inside whole-stage codegen, no Python on the executors.

Faithful mode keeps the reference's quirks (prefixes without a word
boundary, one-word city, all-caps last word treated as a code); see
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical cleaning results).
# ---------------------------------------------------------------------------

# Payment-processor / platform prefixes, as regex alternatives in the order
# they are tried (first match wins), matched case-insensitively at the start.
PROCESSOR_PREFIXES: list[str] = [
    r"SQ\s*\*", r"TST\*?", r"SP\s*\*", r"CLOVER\s*\*", r"WPY\s*\*", r"INT\s*\*",
    r"IZ\s*\*", r"ZETTLE[_\s]*\*?", r"IZETTLE\s*\*?", r"SUMUP\s*\*",
    r"OLO\s*\*", r"RESY\s*\*", r"TOCK\s*\*",
    r"PAYPAL\s*\*?", r"STRIPE\s*\*", r"BRAINTREE\s*\*", r"DRI\s*\*?",
    r"PADDLE(?:\.NET)?\s*\*", r"FASTSPRING\s*\*",
    r"PATREON\s*\*", r"SUBSTACK\s*\*", r"RECURLY\s*\*",
    r"AMAZON\s+(?:MKTPL|RETA)\s*\*?", r"AMZN\s*\*?",
    r"GOOGLE\s*\*", r"GOOG\s*\*", r"MSFT\s*\*",
    r"LYFT\s*\*", r"UBER\s*\*", r"OPENAI\s*\*",
    r"EB\s*\*", r"ETIX\s*\*", r"AXS\s*\*", r"AXSED\s*\*", r"TMCO\s*\*", r"TKTMSTR\s*\*", r"DICE\s*\*",
    r"ETSY\s*\*", r"SHOPIFY\s*\*", r"WOO\s*\*",
    r"CKO\s*\*", r"ADYEN\s*\*", r"WORLDPAY\s*\*", r"HEARTLAND\s*\*", r"SHIFT4\s*\*", r"ELAVON\s*\*",
    r"FLYWIRE\s*\*", r"TOUCHNET\s*\*",
    r"FUNNEL\s*\*?", r"PY\s*\*", r"UEP\s*\*?", r"SNACK\s*\*?", r"PAR\s*\*?", r"CPI\s*\*?", r"CTLP\s*\*?",
    r"WEIXIN\s*\*?", r"ALP\s*\*?",
    r"GRABPAY\s*\*", r"RAZORPAY\s*\*", r"PAYME\s*\*", r"KAKAOPAY\s*\*",
]

# Location codes that may end a description after a one-word city:
# the 50 US states, DC, JP and PL.
LOCATION_CODES: list[str] = [
    "TX", "CA", "NY", "FL", "NV", "UT", "WA", "IL", "PA", "OH",
    "GA", "NC", "MI", "NJ", "VA", "AZ", "MA", "TN", "IN", "MO",
    "MD", "WI", "MN", "CO", "AL", "SC", "LA", "KY", "OR", "OK",
    "CT", "IA", "MS", "KS", "AR", "NM", "NE", "WV", "ID", "HI",
    "ME", "NH", "RI", "MT", "DE", "SD", "AK", "ND", "VT", "WY",
    "DC", "JP", "PL",
]

# Domain endings removed together with the whitespace-led token carrying them.
DOMAIN_SUFFIXES: list[str] = ["com", "org", "net", "gov", "edu", "io", "co", "jp"]

# Characters stripped from both ends after cleaning.
EDGE_CHARS = " -.,*#"

# Minimum length of an all-capitals/digits run that counts as an order code.
CODE_MIN_LEN = 6

# ---------------------------------------------------------------------------
# Patterns. Java regex flavour; (?U) makes \s Unicode-aware like Python's.
# The *_RE2 variants are the same patterns for RE2-based engines (DuckDB
# oracles), where (?U) means something else.
# ---------------------------------------------------------------------------

_PREFIX_BODY = r"^(?:" + "|".join(PROCESSOR_PREFIXES) + r")\s*"
_LOCATION_BODY = r"\s+[A-Z][A-Za-z]*\s+(?:" + "|".join(LOCATION_CODES) + r")\s*$"
_DOMAIN_BODY = r"\s+\S+\.(?:" + "|".join(DOMAIN_SUFFIXES) + r")\S*"
_TRAILING_CODE_BODY = r"\s+[A-Z0-9]{%d,}\s*$" % CODE_MIN_LEN
_CODE_ONLY_BODY = r"^[A-Z0-9]{%d,}$" % CODE_MIN_LEN

PREFIX_RE = "(?iU)" + _PREFIX_BODY
LOCATION_RE = "(?U)" + _LOCATION_BODY
DOMAIN_RE = "(?iU)" + _DOMAIN_BODY
TRAILING_CODE_RE = "(?U)" + _TRAILING_CODE_BODY
CODE_ONLY_RE = _CODE_ONLY_BODY
WHITESPACE_RE = r"(?U)\s+"
# A cleaned value that may be kept: at least 2 characters and not a code.
KEEP_RE = r"(?s)^(?![A-Z0-9]{%d,}$).{2,}$" % CODE_MIN_LEN
# A display merchant that may be kept: at least 3 characters.
KEEP_DISPLAY_RE = r"(?s)^.{3,}$"

PREFIX_RE2 = _PREFIX_BODY
LOCATION_RE2 = _LOCATION_BODY
DOMAIN_RE2 = _DOMAIN_BODY
TRAILING_CODE_RE2 = _TRAILING_CODE_BODY
CODE_ONLY_RE2 = _CODE_ONLY_BODY


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip_prefix(c: Column) -> Column:
    """Drop one leading processor prefix and the blanks after it."""
    return F.regexp_replace(c, PREFIX_RE, "")


def strip_location(c: Column) -> Column:
    """Drop a trailing 'City ST', applied twice."""
    once = F.regexp_replace(c, LOCATION_RE, "")
    return F.regexp_replace(once, LOCATION_RE, "")


def strip_domains(c: Column) -> Column:
    """C4: drop every whitespace-led token containing a known domain."""
    return F.regexp_replace(c, DOMAIN_RE, "")


def strip_trailing_code(c: Column) -> Column:
    """Drop one trailing run of >= 6 capitals/digits."""
    return F.regexp_replace(c, TRAILING_CODE_RE, "")


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs, strip the edge characters."""
    return F.btrim(F.regexp_replace(c, WHITESPACE_RE, " "), F.lit(EDGE_CHARS))


def _keep_or(value: Column, pattern: str, fallback: Column) -> Column:
    """``value`` if it matches ``pattern`` in full, else ``fallback``.
    ``value`` appears once: a CASE that tested and returned it would run the
    whole regex chain once per reference (no subexpression elimination
    inside conditional branches)."""
    return F.coalesce(F.nullif(F.regexp_extract(value, pattern, 0), F.lit("")), fallback)


def clean_description(merchant: Column | str, description: Column | str) -> Column:
    """The cleaned description used as the classification key.
    An empty source cleans to "" and so also falls back to the merchant."""
    m = _text(merchant)
    d = _text(description)
    source = F.when(d != "", d).otherwise(m)                      # C1
    cleaned = squeeze(strip_trailing_code(strip_domains(strip_location(strip_prefix(source)))))
    return _keep_or(cleaned, KEEP_RE, m)                          # C7


def display_merchant(description: Column | str) -> Column:
    """Dialect-B merchant shown to the user: prefix and edge characters
    removed; if fewer than 3 characters remain, the raw description."""
    d = _text(description)
    stripped = F.btrim(F.regexp_replace(d, PREFIX_RE, ""), F.lit(EDGE_CHARS))
    return _keep_or(stripped, KEEP_DISPLAY_RE, d)
