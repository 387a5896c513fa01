"""PII pseudonyms by format-preserving Feistel permutations.

DataFrame and SQL functions only.  One pattern finds candidates; validated ones
are permuted under a key within their own format, so equal values become equal
pseudonyms in every document and different values stay different:

* card numbers of 13 to 19 digits that pass the Luhn check: all digits but the
  last are permuted, the check digit is computed anew, separators stay;
* phone numbers: the last ten digits are permuted, country code and separators
  stay;
* IPv4 addresses with octets up to 255: the 32-bit value is permuted;
* social-security style numbers (3-2-4 digits): the nine digits are permuted;
* calendar dates (ISO, day.month.year, month/day/year) of 1900 to 2099: the day
  number is permuted within that range by cycle walking;
* e-mail addresses, which are not numbers: both sides of the ``@`` get a keyed
  digest.

A value that fails its check (a 16-digit number without a valid check digit, an
octet above 255, 31 February) is left as it is.

The permutation of a value ``A * b + B`` alternates between the halves: in even
rounds A moves by a keyed digest of B modulo a, in odd rounds B by one of A
modulo b.  Every round can be undone, so the whole is a bijection.

Defined cases: a null text stays null and an empty one empty; texts without a
match come back unchanged; all rows and columns stay, repeated rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of 1900-01-01 to 2099-12-31, and the two moduli whose product covers them.
FIRST_DAY, N_DAYS, DAY_A, DAY_B, DAY_WALKS = "1900-01-01", 73049, 271, 270, 12

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+"
_CARD = r"(?<![\p{L}\p{N}+]|\d[.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![\p{L}\p{N}]|[.-]\d)"
_PHONE = r"(?<![\p{L}\p{N}+]|\d[.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\p{L}\p{N}]|[.-]\d)"
_IP = r"(?<![\p{L}\p{N}+]|\d[.-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\p{L}\p{N}]|[.-]\d)"
_SSN = r"(?<![\p{L}\p{N}+]|\d[.-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|[.-]\d)"
_DATE = r"(?<![\p{L}\p{N}+]|\d[.-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\p{L}\p{N}]|[.-]\d)"
PATTERN = "|".join((_EMAIL, _CARD, _PHONE, _IP, _SSN, _DATE))


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(value: str, a: str, b: str, key: str, tweak: str) -> str:
    """SQL for the permutation of ``value`` in 0 .. a * b - 1; the named inputs
    are evaluated once, as they ride along in the accumulator."""
    digest = "cast(conv(substr(sha2(concat_ws('|', {key}, {tweak}, i, {half}), 256), 1, 15), 16, 10) as bigint)"
    by_b = digest.format(key=key, tweak=tweak, half="s.y")
    by_a = digest.format(key=key, tweak=tweak, half="s.x")
    start = f"transform(array(struct(cast({value} as bigint) as v, cast({a} as bigint) as m, cast({b} as bigint) as n)), q -> struct(q.v div q.n as x, q.v % q.n as y, q.m as m, q.n as n))[0]"
    return (
        f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> CASE WHEN i % 2 = 0 "
        f"THEN struct((s.x + {by_b}) % s.m as x, s.y as y, s.m as m, s.n as n) "
        f"ELSE struct(s.x as x, (s.y + {by_a}) % s.n as y, s.m as m, s.n as n) END, s -> s.x * s.n + s.y)"
    )


def _power(n: str) -> str:
    return f"element_at(array({', '.join(f'{10 ** k}L' for k in range(19))}), cast({n} as int) + 1)"


def _permute_digits(d: str, key: str, tweak: str) -> str:
    """SQL: the digit string ``d`` (up to 18 digits) permuted, same length."""
    hi, lo = f"length({d}) - length({d}) div 2", f"length({d}) div 2"
    return f"lpad(cast({_feistel(d, _power(hi), _power(lo), key, tweak)} as string), length({d}), '0')"


def _refill(shape: str, digits: str) -> str:
    """SQL: ``shape`` with its digits replaced, one by one, by those of ``digits``."""
    return (
        f"aggregate(split({shape}, ''), struct('' as o, 1 as k, {digits} as d), (s, c) -> "
        "CASE WHEN c rlike '^[0-9]$' THEN struct(coalesce(concat(s.o, substr(s.d, s.k, 1)), '') as o, s.k + 1 as k, s.d as d) "
        "ELSE struct(coalesce(concat(s.o, c), '') as o, s.k as k, s.d as d) END, s -> s.o)"
    )


def _luhn_sum(d: str, odd: int) -> str:
    """SQL: Luhn sum of digits ``d``; every digit whose place from the right
    (from 1) leaves remainder ``odd`` modulo 2 is doubled."""
    return (
        f"aggregate(transform(split(reverse({d}), ''), (c, j) -> CASE WHEN j % 2 = {1 - odd} "
        f"THEN (2 * cast(c as int)) div 10 + (2 * cast(c as int)) % 10 ELSE cast(c as bigint) END), 0L, (s, v) -> s + v)"
    )


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def pseudonym_sql(m: str, key: str) -> str:
    """SQL expression: the pseudonym of one match ``m``, or ``m`` itself."""
    k = _sql(key)
    card = _let("cd", f"regexp_replace({m}, '[^0-9]', '')", (
        f"CASE WHEN {_luhn_sum('cd', 0)} % 10 = 0 THEN "
        + _let("pd", _permute_digits("substr(cd, 1, length(cd) - 1)", k, "'card'"),
               _refill(m, f"concat(pd, cast((10 - {_luhn_sum('pd', 1)} % 10) % 10 as string))"))
        + f" ELSE {m} END"))
    phone = _let("td", f"regexp_replace({m}, '[^0-9]', '')",
                 _refill(m, f"concat(substr(td, 1, length(td) - 10), {_permute_digits('right(td, 10)', k, chr(39) + 'phone' + chr(39))})"))
    octets = "transform(split({m}, '[.]'), p -> cast(p as bigint))".format(m=m)
    ip = _let("oc", octets, (
        f"CASE WHEN array_max(oc) > 255 THEN {m} ELSE "
        + _let("ov", _feistel("((oc[0] * 256 + oc[1]) * 256 + oc[2]) * 256 + oc[3]", "65536L", "65536L", k, "'ip'"),
               "concat_ws('.', ov div 16777216, (ov div 65536) % 256, (ov div 256) % 256, ov % 256)")
        + " END"))
    ssn = _refill(m, _permute_digits(f"replace({m}, '-', '')", k, "'ssn'"))
    walk = _feistel("w", f"{DAY_A}L", f"{DAY_B}L", k, "'date'")

    def date(parse: str, shape: str) -> str:
        day = f"datediff({parse}, date'{FIRST_DAY}')"
        moved = f"aggregate(sequence(1, {DAY_WALKS}), struct(dn as w, false as done), (s, i) -> CASE WHEN s.done THEN s ELSE " + _let("w", "s.w", _let("nw", walk, f"struct(nw as w, coalesce(nw < {N_DAYS}, true) as done)")) + " END, s -> s.w)"
        return _let("dn", f"cast({day} as bigint)", f"CASE WHEN dn is null or dn < 0 or dn >= {N_DAYS} THEN {m} ELSE date_format(date_add(date'{FIRST_DAY}', cast({moved} as int)), '{shape}') END")

    iso = date(f"try_to_date({m}, 'yyyy-MM-dd')", "yyyy-MM-dd")
    dotted = date(f"try_to_date({m}, 'dd.MM.yyyy')", "dd.MM.yyyy")
    slashed = date(f"try_to_date({m}, 'MM/dd/yyyy')", "MM/dd/yyyy")
    mail = _let("h", f"sha2(concat_ws('|', {k}, 'mail', lower({m})), 256)", "concat('u', substr(h, 1, 16), '@h', substr(h, 17, 8), '.example.invalid')")
    return (
        f"CASE WHEN instr({m}, '@') > 0 THEN {mail} "
        f"WHEN {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' THEN {iso} "
        f"WHEN {m} rlike '^[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}$' THEN {dotted} "
        f"WHEN {m} rlike '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$' THEN {slashed} "
        f"WHEN {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {ssn} "
        f"WHEN {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN {ip} "
        f"WHEN {m} rlike '^([0-9]{{13,19}}|[0-9]{{4}}([ -])[0-9]{{4}}.[0-9]{{4}}.[0-9]{{4}})$' THEN {card} "
        f"ELSE {phone} END"
    )


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the text column pseudonymised; ``count_col`` adds the
    number of replaced values.

    The text is cut at the matches and put together again with their
    pseudonyms; both cuts use the same pattern, so the pieces line up.
    """
    m, p, r = "__pii_matches", "__pii_pieces", "__pii_new"
    text = F.col(text_col)
    likely = text.rlike("[0-9@]")
    out = docs.withColumns({
        m: F.when(likely, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))),
    }).withColumns({
        p: F.when(F.size(m) > 0, F.split(text, PATTERN, -1)),
        r: F.expr(f"CASE WHEN size({m}) > 0 THEN transform({m}, x -> {pseudonym_sql('x', key)}) END"),
    })
    whole = F.expr(f"concat(array_join(zip_with(slice({p}, 1, size({r})), {r}, (a, b) -> concat(a, b)), ''), element_at({p}, -1))")
    if count_col:
        out = out.withColumn(count_col, F.expr(f"coalesce(aggregate(zip_with({m}, {r}, (a, b) -> cast(a != b as int)), 0, (s, x) -> s + x), 0)"))
    return out.withColumn(text_col, F.when(F.size(m) > 0, whole).otherwise(text)).drop(m, p, r)
