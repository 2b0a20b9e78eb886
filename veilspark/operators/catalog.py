"""The catalog of patterns. Order matters: it breaks ties between overlapping detections."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """gate: a cheap expression that every text with a match matches, to spare the others. group: the group that is the value."""

    kind: str
    severity: str
    regex: str
    base: float
    near: tuple[str, ...] = ()
    check: str | None = None
    must_pass: bool = False
    group: int = 0
    gate: str | None = None
    value: str | None = None


# Types, severities, expressions, base confidences and the words expected beside a value. The words beside a
# passport number are the letters of "passport", as there.
PATTERNS = (
    Pattern("PRIVATE_KEY", "critical", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", 0.99, gate=r"PRIVATE KEY-----"),
    Pattern("AWS_ACCESS_KEY", "critical", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0.98, gate=r"AKIA|ASIA"),
    Pattern("API_KEY", "critical", r"\bsk-(?:live-|test-|proj-)?[A-Za-z0-9][A-Za-z0-9\]/|.\-_]{14,70}", 0.97, ("api", "key", "secret", "openai"), gate=r"sk-"),
    Pattern("ACCESS_TOKEN", "high", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", 0.97, ("token", "github", "access"), gate=r"gh[pousr]_"),
    Pattern("JWT_TOKEN", "high", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", 0.96, gate=r"eyJ"),
    Pattern("PASSWORD", "high", r"(?i)\b(?:password|passwd|pwd|secret)\s*[:=]\s*(\S{4,})", 0.90, ("password", "secret", "login"), group=1, gate=r"(?iuU)(?:password|passwd|pwd|secret)\s*[:=]"),
    Pattern("CREDIT_CARD", "critical", r"\b(?:\d[ -]?){12,18}\d\b", 0.90, ("card", "credit", "debit", "visa", "mastercard", "cvv"), check="luhn", must_pass=True, gate=r"(?:\p{Nd}[ -]?){12}\p{Nd}"),
    Pattern("CVV", "high", r"(?i)\b(?:cvv|cvc|card verification(?:\s+value)?)\b", 0.50, value=r"\d{3,4}", gate=r"(?iu)cvv|cvc|card verification"),
    Pattern("CARD_EXPIRY", "medium", r"(?i)\b(?:valid\s+thru|valid\s+through|expiry|expiration|exp)\b", 0.50, value=r"(?:0[1-9]|1[0-2])\s*/\s*\d{2,4}", gate=r"(?iuU)valid\s+th|expi|\bexp\b"),
    Pattern("IBAN", "high", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.90, ("iban", "bank", "account"), gate=r"[A-Z]{2}\p{Nd}{2}[A-Z0-9]{11}"),
    Pattern("SWIFT_BIC", "high", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.70, ("swift", "bic", "bank"), gate=r"[A-Z]{6}[A-Z0-9]{2}"),
    Pattern("IFSC", "high", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.90, ("ifsc", "bank", "branch"), gate=r"[A-Z]{4}0[A-Z0-9]{6}"),
    Pattern("UPI_ID", "high", r"\b[A-Za-z0-9.\-_]{2,}@(?:okhdfcbank|oksbi|okaxis|okicici|paytm|ybl|upi|apl|axl)\b", 0.95, ("upi", "vpa", "pay"), gate=r"@(?:ok|paytm|ybl|upi|apl|axl)"),
    Pattern("CRYPTO_WALLET", "high", r"\b(?:0x[a-fA-F0-9]{40}|bc1[a-z0-9]{25,59}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b", 0.85, ("wallet", "btc", "eth", "bitcoin", "ethereum"), gate=r"0x[a-fA-F0-9]{40}|bc1[a-z0-9]{25}|[13][a-km-zA-HJ-NP-Z1-9]{25}"),
    Pattern("AADHAAR", "critical", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b", 0.85, ("aadhaar", "uidai", "aadhar", "uid"), check="verhoeff", gate=r"\p{Nd}{4}[ -]?\p{Nd}{4}[ -]?\p{Nd}{4}"),
    Pattern("PAN", "critical", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.92, ("pan", "permanent account"), gate=r"[A-Z]{5}\p{Nd}{4}[A-Z]"),
    Pattern("SSN", "critical", r"\b\d{3}-\d{2}-\d{4}\b", 0.90, ("ssn", "social security"), gate=r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}"),
    Pattern("PASSPORT", "critical", r"\b[A-Z][0-9]{7}\b", 0.72, tuple("passport"), gate=r"[A-Z][0-9]{7}"),
    Pattern("UK_NINO", "critical", r"\b[ABCEGHJ-PRSTW][ABCEGHJ-NPRSTW]\d{6}[A-D]\b", 0.88, ("national insurance", "nino"), gate=r"[A-Z]{2}\p{Nd}{6}[A-D]"),
    Pattern("KR_RRN", "critical", r"\b\d{6}-[1-4]\d{6}\b", 0.90, ("resident registration", "rrn"), gate=r"\p{Nd}{6}-[1-4]\p{Nd}{6}"),
    Pattern("EMAIL", "medium", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.98, ("email", "mail", "contact"), gate=r"@"),
    Pattern("PHONE", "medium", r"(?<![\w.])\+?\d{1,3}[ -]?(?:\d[ -]?){8,11}\d(?![\w.])", 0.70, ("phone", "mobile", "tel", "call", "contact"), gate=r"(?:\p{Nd}[ -]?){9}\p{Nd}"),
    Pattern("IP_ADDRESS", "low", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.90, ("ip", "address", "host", "server"), check="ipv4", must_pass=True, gate=r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}"),
    Pattern("MAC_ADDRESS", "low", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", 0.90, ("mac", "hardware"), gate=r"(?:[0-9A-Fa-f]{2}:){5}"),
)

#: Types that share a cheaper gate: a text that does not match it matches the gate of none of them.
FAMILIES = (
    (r"PRIVATE KEY-----|AKIA|ASIA|sk-|gh[pousr]_|eyJ", ("PRIVATE_KEY", "AWS_ACCESS_KEY", "API_KEY", "ACCESS_TOKEN", "JWT_TOKEN")),
    (r"[A-Z][A-Z\p{Nd}]{7}", ("IBAN", "IFSC", "PAN", "PASSPORT", "UK_NINO")),
    (r"\p{Nd}(?:[ -]?\p{Nd}){8}", ("CREDIT_CARD", "AADHAAR", "PHONE", "SSN", "KR_RRN")),
    (r"[cC][vV][vVcC]|[cC][aA][rR][dD]|[eE][xX][pP]|[vV][aA][lL]", ("CVV", "CARD_EXPIRY")),
    (r"[pP](?:[aA][sSſ][sSſ][wW]|[wW][dD])|[sSſ][eE][cC][rR][eE][tT]", ("PASSWORD",)),
)

BY_KIND = {p.kind: p for p in PATTERNS}
SEVERITY = {p.kind: p.severity for p in PATTERNS} | {"ADDRESS": "medium", "CUSTOM_PATTERN": "medium"}
#: Numbers without a form of their own: the context alone decides on them.
BARE_NUMBERS = ("AADHAAR", "CREDIT_CARD", "DEBIT_CARD", "PHONE")
#: Types whose own checksum weighs more than words that speak against them.
STRONGLY_CHECKED = ("CREDIT_CARD", "DEBIT_CARD", "AADHAAR", "IP_ADDRESS")
#: Weights of severities in the privacy score, and the share that a protected detection leaves.
RISK = {"low": 4, "medium": 8, "high": 14, "critical": 20}
RESIDUAL = 0.06
