"""Masking of personal data with built-in functions only; keys are parameters and never stored."""

from __future__ import annotations

import hashlib
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.cleaning import col

# Tokens, formats and scrub patterns (applied in this order).
UNKNOWN_TOKEN = "ANON-UNKNOWN"
ADDRESS_TOKEN = "[ADDRESS REDACTED]"
EMAIL_TOKEN = "[EMAIL REDACTED]"
BIRTH_DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
]
SCRUB_PATTERNS = [
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN-REDACTED]"),
    (r"\b\d{9}\b", "[SSN-REDACTED]"),
    (r"\(?\d{3}\)?[\s\-\.]\d{3}[\s\-\.]\d{4}", "[PHONE-REDACTED]"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL-REDACTED]"),
    (r"\b(Mr\.|Mrs\.|Ms\.|Dr\.)\s+[A-Z][a-z]+\b", "[NAME-REDACTED]"),
    (r"\bMRN[\s:]?\d{6,10}\b", "[MRN-REDACTED]"),
]

# The e-mail pattern tries every start of a long run of letters and takes quadratic time on junk text. This form starts
# only where a run begins, or right after the previous match, and never gives back a run; it finds the same matches.
_LINEAR_FORMS = {
    SCRUB_PATTERNS[3][0]: r"(?:(?<![a-zA-Z0-9._%+\-])|\G)[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
}

_BLOCK = 64


def hmac_sha256(c: Column | str, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text column, composed from ``sha2``."""
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    message = F.encode(col(c), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def pseudonymize(c: Column | str, key: bytes) -> Column:
    """Stable ``ANON-`` token; blank text and ``nan`` share one token, NULL stays NULL."""
    value = col(c).cast("string")
    stripped = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    token = F.concat(F.lit("ANON-"), F.upper(F.left(hmac_sha256(value, key), F.lit(8))))
    return F.when(value.isNull(), F.lit(None).cast("string")).when(
        stripped.isin("", "nan"), UNKNOWN_TOKEN
    ).otherwise(token)


def _digits(c: Column | str) -> Column:
    return F.regexp_replace(col(c).cast("string"), r"\D", "")


def mask_ssn(c: Column | str) -> Column:
    digits = _digits(c)
    return F.when(F.length(digits) == 9, F.concat(F.lit("***-**-"), F.right(digits, F.lit(4)))).when(
        digits.isNotNull(), "***-**-****"
    )


def mask_phone(c: Column | str) -> Column:
    digits = _digits(c)
    return F.when(F.length(digits) >= 10, F.concat(F.left(digits, F.lit(3)), F.lit("-***-****"))).when(
        digits.isNotNull(), "***-***-****"
    )


def mask_address(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), ADDRESS_TOKEN)


def mask_email(c: Column | str) -> Column:
    domain = F.regexp_extract(col(c), r"@([a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})", 1)
    return F.when(domain != "", F.concat(F.lit("@"), domain)).when(domain.isNotNull(), EMAIL_TOKEN)


def generalize_year(c: Column | str) -> Column:
    """Four-digit year of a birth date in any of the known formats."""
    value = col(c).cast("string")
    parsed = F.coalesce(
        *[
            F.when(value.rlike(pattern), F.try_to_timestamp(value, F.lit(fmt)))
            for pattern, fmt in BIRTH_DATE_FORMATS
        ]
    )
    return F.when(value.isNotNull(), F.coalesce(F.year(parsed).cast("string"), F.lit("UNKNOWN")))


def scrub_text(c: Column | str) -> Column:
    """Replace identifiers in free text, pattern by pattern, with Unicode word boundaries.

    The e-mail step runs only on texts with an ``@``; no earlier step adds or removes one that could matter.
    """
    original = text = col(c)
    for pattern, token in SCRUB_PATTERNS:
        replaced = F.regexp_replace(text, "(?U)" + _LINEAR_FORMS.get(pattern, pattern), token)
        text = F.when(original.contains("@"), replaced).otherwise(text) if pattern in _LINEAR_FORMS else replaced
    return text
