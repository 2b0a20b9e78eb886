"""Masks for detected values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .validators import digits_only

DOT = "•"
HIDDEN = "[REDACTED]"


def _dots(n: Column) -> Column:
    return F.repeat(F.lit(DOT), n.cast("int"))


def _last4(digits: Column, filler: str) -> Column:
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(F.lit(filler))


def mask_value(kind: Column, raw: Column) -> Column:
    """The value as it may be shown, by type."""
    digits, size = digits_only(raw), F.length(raw)
    user, host = F.substring_index(raw, "@", 1), F.when(F.contains(raw, F.lit("@")), F.substring(raw, F.instr(raw, "@") + 1, F.length(raw))).otherwise(F.lit(""))
    initial = lambda s: F.when(F.length(s) > 0, F.left(s, F.lit(1))).otherwise(F.lit(DOT))
    word = F.split(raw, "[, ]", 2)[0]
    return (
        F.when(kind.isin("CREDIT_CARD", "DEBIT_CARD"), F.concat(F.lit("XXXX XXXX XXXX "), _last4(digits, "XXXX")))
        .when(kind == "AADHAAR", F.concat(F.lit("XXXX XXXX "), _last4(digits, "XXXX")))
        .when(kind == "SSN", F.concat(F.lit("XXX-XX-"), _last4(digits, "XXXX")))
        .when(kind == "PHONE", F.concat(F.lit("+•• •••••"), _last4(digits, DOT * 4)))
        .when(kind == "EMAIL", F.concat(initial(user), F.lit("•••@"), initial(host), F.lit("••.•••")))
        .when(kind.isin("API_KEY", "AWS_ACCESS_KEY"), F.concat(F.left(raw, F.lit(3)), F.lit("-" + DOT * 12)))
        .when(kind == "ACCESS_TOKEN", F.concat(F.left(raw, F.lit(4)), F.lit(DOT * 12)))
        .when(kind == "JWT_TOKEN", F.lit("eyJ••••.••••••.••••"))
        .when(kind == "PRIVATE_KEY", F.lit("-----BEGIN PRIVATE KEY----- ••••"))
        .when(kind == "PASSWORD", _dots(F.least(F.greatest(size, F.lit(8)), F.lit(12))))
        .when(kind == "CVV", _dots(F.greatest(F.lit(3), F.length(digits))))
        .when(kind == "CARD_EXPIRY", F.lit("••/••"))
        .when(kind.isin("IP_ADDRESS", "MAC_ADDRESS"), F.lit("•••.•••.•.•"))
        .when(kind == "PAN", F.concat(F.left(raw, F.lit(2)), F.lit(DOT * 5), F.right(raw, F.lit(1))))
        .when(kind.isin("IBAN", "SWIFT_BIC", "IFSC", "UPI_ID", "CRYPTO_WALLET"), F.concat(F.left(raw, F.lit(2)), F.lit(DOT * 8), F.right(raw, F.lit(2))))
        .when(kind == "ADDRESS", F.concat(F.coalesce(word, F.lit("")), F.lit(" •••••••, •••")))
        .when(kind == "CUSTOM_PATTERN", _dots(F.least(F.greatest(F.length(F.trim(raw)), F.lit(4)), F.lit(16))))
        .otherwise(F.lit(HIDDEN))
    )


def mask_ends(value: Column, keep: int, filler: str) -> Column:
    """Keep that many characters at both ends; a short value is hidden whole, a null one is "<none>"."""
    size = F.length(value)
    fill = lambda n: F.repeat(F.lit(filler), n)
    return F.when(value.isNull(), F.lit("<none>")).when(size <= 2 * keep, fill(size)).otherwise(F.concat(F.left(value, F.lit(keep)), fill(size - 2 * keep), F.right(value, F.lit(keep))))


def mask_for_log(value: Column, keep: int = 2) -> Column:
    return mask_ends(value, keep, DOT)


def mask_candidate(value: Column, keep: int = 4) -> Column:
    return mask_ends(value, keep, "*")


def mask_for_client(kind: Column, raw: Column) -> Column:
    """The client's variant: phones keep five digits, short digit runs stay, and types it does not know are hidden."""
    digits = digits_only(raw)
    tail = lambda n, filler: F.when(F.length(digits) > 0, F.right(digits, F.lit(n))).otherwise(F.lit(filler))
    return (
        F.when(kind.isin("CREDIT_CARD", "DEBIT_CARD"), F.concat(F.lit("XXXX XXXX XXXX "), tail(4, "XXXX")))
        .when(kind == "AADHAAR", F.concat(F.lit("XXXX XXXX "), tail(4, "XXXX")))
        .when(kind == "PHONE", F.concat(F.lit("+•• •••••"), tail(5, DOT * 5)))
        .when(kind.isin("API_KEY", "ACCESS_TOKEN", "JWT_TOKEN", "PASSWORD", "EMAIL", "ADDRESS"), mask_value(kind, raw))
        .otherwise(F.lit(HIDDEN))
    )
