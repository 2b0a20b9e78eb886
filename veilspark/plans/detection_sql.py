"""SQL of the whole text scan: candidates, context points, thresholds, overlaps and masks, for tables with Latin letters.

The tables of expressions and words are those of the catalog; what is done with them is said again here, set by set. As the other side
knows ASCII letters only, positions come from a copy of the text in which every other letter is ``_``, values from the text.
"""

from __future__ import annotations

from ..functions.keywords import ADDRESS_CUES, ADDRESS_POINTS, ADDRESS_POSTAL, NEGATIVE, TIERS
from ..operators.catalog import PATTERNS, RESIDUAL, RISK

_ORD = {p.kind: i for i, p in enumerate(PATTERNS)}
_ADDRESS = len(PATTERNS)
#: The other side has no look-around: a number stands between two characters that may not be beside it, and only the number counts.
_PHONE = r"[^\w.](\+?\d{1,3}[ -]?(?:\d[ -]?){8,11}\d)[^\w.]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_text(t)})" for t in terms) + ")" if terms else "false"


def _cut(kinds: list[str]) -> str:
    """Matches w of each expression, the part n of it that is the value, and the gap g before it."""
    parts = []
    for kind in kinds:
        p = PATTERNS[_ORD[kind]]
        r, group, t = (_text(_PHONE), 1, "' ' || t || ' '") if kind == "PHONE" else (_text(p.regex), p.group, "t")
        lists = f"list_zip(regexp_extract_all({t}, {r}), regexp_extract_all({t}, {r}, {group}), string_split_regex({t}, {r}), range(length({t})))"
        parts.append(f"SELECT rid, {_ORD[kind]} AS ord, unnest(list_filter({lists}, lambda z: z[1] IS NOT NULL)) AS z FROM docs WHERE regexp_matches({t}, {r})")
    return " UNION ALL ".join(parts)


def _case(values: dict[int, str], other: str) -> str:
    return "CASE ord " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END" if values else other


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def _clip(start: str, stop: str) -> str:
    return f"trim(regexp_replace(lower(substr(text, greatest({start}, 0) + 1, least({stop}, length(text)) - greatest({start}, 0))), '\\s+', ' ', 'g'))"


def _passed(luhn: str, verhoeff: str) -> str:
    octets = "list_bool_and(list_transform(string_split(value, '.'), lambda p: CAST(p AS INT) <= 255 AND (length(p) = 1 OR p[1] <> '0')))"
    return _case({_ORD["CREDIT_CARD"]: f"length(digits) >= 12 AND {luhn}", _ORD["AADHAAR"]: verhoeff, _ORD["IP_ADDRESS"]: octets}, "NULL")


def address_flags(source: str) -> str:
    """The rows of ``source`` with what their text says of an address: a flag for each kind of cue, postal, pin, house."""
    words = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
    cues = ", ".join(f"{_any('n_', terms)} AS {name}_" for name, (_, _, terms) in ADDRESS_CUES.items())
    pin = r"""len(list_filter(regexp_extract_all(text, '\d[\d ]*\d'), lambda r: length(replace(r, ' ', '')) >= 10 OR (length(replace(r, ' ', '')) >= 7 AND NOT contains(r, ' ')))) = 0
        AND (regexp_matches(text, '(?:^|\D)\d{3}\s?\d{3}(?:\D|$)') OR regexp_matches(text, '(?:^|\D)\d{5,6}(?:\D|$)'))"""
    house = r"regexp_matches(text, '(?i)(?:^|[\n\r\x0b\f])\s*(?:flat|plot|door|house|no\.?|#)?\s*#?\d{1,4}[a-z]?\s*[,/\-]')"
    return f"SELECT *, {cues}, {_any('n_', ADDRESS_POSTAL)} AS postal_, {pin} AS pin_, {house} AS house_ FROM (SELECT *, {words} AS n_ FROM {source})"


#: Whether a text says anything of an address, over the flags.
ADDRESS_CUE = "(" + " OR ".join([*(f"{name}_" for name in ADDRESS_CUES), "postal_", "pin_", "house_"]) + ")"


def address_points(many_lines: str = "false") -> str:
    """The points of a text as an address, over the flags."""
    points = " + ".join(f"CASE WHEN {name}_ THEN {p} ELSE 0 END" for name, (p, _, _) in ADDRESS_CUES.items())
    points += f" + CASE WHEN pin_ THEN {ADDRESS_POINTS['pincode']} WHEN postal_ THEN {ADDRESS_POINTS['postal']} ELSE 0 END + CASE WHEN house_ THEN {ADDRESS_POINTS['house']} ELSE 0 END"
    points += f" + CASE WHEN {many_lines} THEN {ADDRESS_POINTS['lines']} ELSE 0 END"
    count = " + ".join(f"CAST({c} AS INT)" for c in (*[f"{name}_" for name in ADDRESS_CUES], "(pin_ OR postal_)"))
    return f"least(100, CASE WHEN {count} >= 2 THEN {points} ELSE least({points}, 30) END)"


def _address() -> str:
    return f"""SELECT rid, {_ADDRESS} AS ord, 0 AS start, length(text) AS stop, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS value, round(least(0.99, points / 100.0), 4) AS confidence FROM (
        SELECT *, {address_points()} AS points FROM ({address_flags("docs")})) WHERE points >= 45"""


def mask(kind: str, value: str) -> str:
    """The mask of a value by its type."""
    digits, host = _digits(value), f"CASE WHEN contains({value}, '@') THEN substr({value}, strpos({value}, '@') + 1) ELSE '' END"
    four = lambda filler: f"CASE WHEN length({digits}) >= 4 THEN right({digits}, 4) ELSE '{filler}' END"
    return f"""CASE WHEN {kind} = 'CREDIT_CARD' THEN 'XXXX XXXX XXXX ' || {four('XXXX')} WHEN {kind} = 'AADHAAR' THEN 'XXXX XXXX ' || {four('XXXX')} WHEN {kind} = 'SSN' THEN 'XXX-XX-' || {four('XXXX')}
        WHEN {kind} = 'PHONE' THEN '+•• •••••' || {four('••••')} WHEN {kind} = 'EMAIL' THEN left({value}, 1) || '•••@' || left({host}, 1) || '••.•••'
        WHEN {kind} IN ('API_KEY', 'AWS_ACCESS_KEY') THEN left({value}, 3) || '-' || repeat('•', 12) WHEN {kind} = 'ACCESS_TOKEN' THEN left({value}, 4) || repeat('•', 12)
        WHEN {kind} = 'JWT_TOKEN' THEN 'eyJ••••.••••••.••••' WHEN {kind} = 'PRIVATE_KEY' THEN '-----BEGIN PRIVATE KEY----- ••••' WHEN {kind} = 'PASSWORD' THEN repeat('•', least(greatest(length({value}), 8), 12))
        WHEN {kind} = 'CVV' THEN repeat('•', greatest(3, length({digits}))) WHEN {kind} = 'CARD_EXPIRY' THEN '••/••' WHEN {kind} IN ('IP_ADDRESS', 'MAC_ADDRESS') THEN '•••.•••.•.•'
        WHEN {kind} = 'PAN' THEN left({value}, 2) || '•••••' || right({value}, 1) WHEN {kind} IN ('IBAN', 'SWIFT_BIC', 'IFSC', 'UPI_ID', 'CRYPTO_WALLET') THEN left({value}, 2) || repeat('•', 8) || right({value}, 2)
        WHEN {kind} = 'ADDRESS' THEN regexp_extract({value}, '^[^, ]*') || ' •••••••, •••' ELSE '[REDACTED]' END"""


def found_sql(source: str, keys: list[str], text: str, luhn: str, verhoeff: str, letters: str, kinds: list[str] | None = None) -> str:
    """CTEs up to ``found``: rid, the keys, start, stop, type, value, severity, confidence; ``docs`` has every row with its rid and text.

    luhn and verhoeff: conditions over ``digits``. letters: the copy of the column ``text`` with other letters as ``_``.
    """
    chosen = [p for p in PATTERNS if kinds is None or p.kind in kinds]
    named = [p.kind for p in chosen if p.value]
    moving = [k for k in ("CREDIT_CARD", "AADHAAR", "PHONE", "IP_ADDRESS", "SWIFT_BIC", "CVV", "CARD_EXPIRY") if kinds is None or k in kinds]
    tier = lambda i: _case({_ORD[k]: _any("around", TIERS[k][i]) for k in moving}, "false")
    near = _case({_ORD[k]: "true" if k in named else _any("beside", PATTERNS[_ORD[k]].near) for k in moving}, "false")
    bare, checked = (f"ord IN ({', '.join(str(_ORD[k]) for k in ks)})" for ks in (("AADHAAR", "CREDIT_CARD", "PHONE"), ("CREDIT_CARD", "AADHAAR", "IP_ADDRESS")))
    labelled, must = (f"ord IN ({', '.join(str(_ORD[k]) for k in ks)})" for ks in (("CVV", "CARD_EXPIRY"), ("CREDIT_CARD", "IP_ADDRESS")))
    values = _case({_ORD[k]: f"regexp_extract(substr(t, stop + 1, 24), {_text(PATTERNS[_ORD[k]].value)})" for k in named}, "''")
    base = _case({_ORD[p.kind]: str(p.base) for p in chosen}, "0")
    kind = _case({_ORD[p.kind]: _text(p.kind) for p in chosen}, "'ADDRESS'")
    severity = _case({_ORD[p.kind]: _text(p.severity) for p in chosen}, "'medium'")
    address = f"UNION ALL {_address()}" if kinds is None or "ADDRESS" in kinds else ""
    return f"""WITH RECURSIVE source AS (SELECT {', '.join(keys)}, coalesce({text}, '') AS text FROM {source}),
        docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, {', '.join(keys)}, text, {letters} AS t FROM source),
        cut AS ({_cut([p.kind for p in chosen])}),
        part AS (SELECT rid, ord, z[1] AS w, z[2] AS n, length(z[3]) AS g, z[4] AS i FROM cut),
        reached AS (SELECT *, sum(g + length(w)) OVER (PARTITION BY rid, ord ORDER BY i) - length(w) AS pos FROM part),
        whole AS (SELECT rid, ord, CAST(pos + length(w) - length(n) AS INT) AS start, CAST(pos + length(w) AS INT) AS stop FROM reached WHERE ord <> {_ORD['PHONE']}
            UNION ALL SELECT rid, ord, CAST(pos AS INT), CAST(pos + length(n) AS INT) FROM reached WHERE ord = {_ORD['PHONE']}),
        labels_ AS (SELECT rid, ord, start AS label, stop, t, {values} AS v FROM whole JOIN docs USING (rid) WHERE {labelled}),
        placed AS (SELECT rid, ord, start, stop, start AS first FROM whole WHERE NOT {labelled}
            UNION ALL SELECT rid, ord, CAST(stop + strpos(substr(t, stop + 1, 24), v) - 1 AS INT), CAST(stop + strpos(substr(t, stop + 1, 24), v) - 1 + length(v) AS INT), label FROM labels_ WHERE v <> ''),
        seen AS (SELECT rid, ord, start, stop, substr(text, start + 1, stop - start) AS value, {_digits('substr(text, start + 1, stop - start)')} AS digits,
            {_clip('first - 48', 'stop + 48')} AS around, {_clip('start - 20', 'stop + 12')} AS beside FROM placed JOIN docs USING (rid)),
        said AS (SELECT *, {_passed(luhn, verhoeff)} AS passed, {tier(0)} AS s, {tier(1)} AS m, {tier(2)} AS k, {_any('around', NEGATIVE)} AS bad, {near} AS close FROM seen),
        rated AS (SELECT *, greatest(0, least(100, 20 + CASE WHEN s THEN 30 ELSE 0 END + CASE WHEN m THEN 15 ELSE 0 END + CASE WHEN k AND NOT s AND NOT m THEN 6 ELSE 0 END
            + CASE WHEN close AND (s OR m) THEN 10 ELSE 0 END + CASE WHEN s AND m THEN 10 ELSE 0 END + CASE WHEN passed IS NULL THEN 0 WHEN passed THEN 40 WHEN s THEN -12 ELSE -30 END
            - CASE WHEN NOT bad THEN 0 WHEN {checked} AND passed THEN 10 ELSE 30 END - CASE WHEN {bare} AND NOT s AND NOT m AND NOT coalesce(passed, false) THEN 20 ELSE 0 END)) / 100.0 AS model
            FROM said WHERE (NOT {must} OR passed) AND (NOT {labelled} OR s OR m OR k OR bad)),
        sure AS (SELECT rid, ord, start, stop, value, round(least(0.99, CASE WHEN {bare} THEN model WHEN {labelled} THEN greatest(model, 0.6)
            WHEN ord IN ({_ORD['IP_ADDRESS']}, {_ORD['SWIFT_BIC']}) THEN greatest(model, {base}) ELSE {base} END), 4) AS confidence FROM rated),
        ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, stop - start DESC, ord, start) AS n FROM sure WHERE confidence >= 0.45),
        fold AS (SELECT DISTINCT rid, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(a INT, b INT, n BIGINT)[]) AS kept FROM ranked
            UNION ALL SELECT f.rid, r.n, CASE WHEN len(list_filter(f.kept, lambda x: x.a < r.stop AND r.start < x.b)) = 0 THEN list_append(f.kept, {{'a': r.start, 'b': r.stop, 'n': r.n}}) ELSE f.kept END
            FROM fold f JOIN ranked r ON r.rid = f.rid AND r.n = f.n + 1),
        stays AS (SELECT rid, unnest(kept).n AS n FROM (SELECT rid, arg_max(kept, n) AS kept FROM fold GROUP BY rid)),
        every AS (SELECT rid, ord, start, stop, value, confidence FROM ranked JOIN stays USING (rid, n) {address}),
        found AS (SELECT rid, {', '.join(keys)}, start, stop, {kind} AS type, value, {severity} AS severity, CAST(confidence AS DOUBLE) AS confidence FROM every JOIN docs USING (rid))"""


def detections_sql(found: str, keys: list[str]) -> str:
    return f"""{found} SELECT {', '.join(keys)}, type, {mask('type', 'value')} AS text, confidence, severity, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS h, 'protected' AS status, true AS verification_passed, 1 AS attempts FROM found"""


def summaries_sql(found: str, keys: list[str]) -> str:
    weight = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RISK.items()) + " END"
    return f"""{found}, counted AS (SELECT rid, count(*) AS n, count(*) FILTER (severity = 'critical') AS c, sum({weight}) * {RESIDUAL} AS r FROM found GROUP BY rid)
        SELECT {', '.join(keys)}, 'completed' AS status, coalesce(n, 0) AS total_detections, coalesce(c, 0) AS critical_count, coalesce(n, 0) AS protected_count,
        CASE WHEN n IS NULL THEN 100.0 ELSE round(greatest(0.0, 100.0 - CAST(r AS DOUBLE)), 1) END AS privacy_score,
        CASE WHEN n IS NULL THEN 100 ELSE CAST(least(99, 100 - greatest(2, floor(CAST(r AS DOUBLE) + 0.5))) AS INT) END AS client_score FROM docs LEFT JOIN counted USING (rid)"""


def report_sql(found: str) -> str:
    return f"{found} SELECT type, count(*) AS n, max(confidence) AS confidence, count(*) AS protected FROM found GROUP BY type"


def totals_sql(found: str) -> str:
    return f"{found} SELECT count(*) AS total, count(*) AS protected, 0 AS exposed, CAST(coalesce(floor(avg(confidence) * 100 + 0.5), 0) AS BIGINT) AS avg_confidence FROM found"


def redacted_sql(found: str, keys: list[str]) -> str:
    """The text with every detection replaced by its mask."""
    return f"""{found}, gap AS (SELECT rid, start, stop, {mask('type', 'value')} AS hidden, coalesce(lag(stop) OVER (PARTITION BY rid ORDER BY start), 0) AS before FROM found),
        head AS (SELECT rid, string_agg(substr(docs.text, before + 1, start - before) || hidden, '' ORDER BY start) AS head, max(stop) AS last FROM gap JOIN docs USING (rid) GROUP BY rid)
        SELECT {', '.join(keys)}, coalesce(head, '') || substr(text, coalesce(last, 0) + 1) AS text FROM docs LEFT JOIN head USING (rid)"""
