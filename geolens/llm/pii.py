"""Personal data: format-preserving pseudonyms by keyed Feistel networks, in SQL functions only.

Found are e-mail addresses, telephone numbers, payment card numbers, IPv4 addresses and dates.  A find must be
valid (card: Luhn digit; address: octets up to 255; date: on the calendar, 1800 to 2199; telephone: 10 to 15
digits), else it stays.  A valid one is permuted within its format: letters become letters, digits digits, signs
stay.  The permutation depends on the key and the kind only, so equal values stay linked across documents, and
the key's owner can undo it (``inverse=True``).

* text: halves of a string, each character shifted within its class by a keystream of the other half; for
  e-mails (lower case; the name, and the domain but its last label), the last ten digits of telephone numbers, and
  all but the last digit of cards, whose Luhn digit is then set again;
* numbers: two residues, each shifted by a hash of the other; for IPv4 addresses (2^16 x 2^16) and days
  (400 years are 146,097 = 189 x 773 days).

Everything is a projection: no shuffle, no Python.  The key is a literal of the query plan; take it from where
your secrets live, and don't publish plans.

Defined cases: a null text stays null with no finds, an empty one empty; finds don't overlap, the first from the
left wins; repeated rows are rewritten one by one; other columns pass through, ones named like a result column
are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:[.][0-9]{1,3}){3}(?![0-9]|[.][0-9])"
_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
_CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
)
_PHONE = (
    r"(?:[+][0-9]{1,3}[ .-]?(?:[(][0-9]{2,4}[)]|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[(][0-9]{3}[)] ?[0-9]{3}[-. ][0-9]{4}"
    r"|(?<![0-9A-Za-z])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![0-9])"
)
PATTERN = "|".join((_EMAIL, _IP, _DATE, _CARD, _PHONE))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _order(inverse: bool) -> str:
    return f"sequence({ROUNDS - 1}, 0, -1)" if inverse else f"sequence(0, {ROUNDS - 1})"


def _shifted(value: str, other: str, key: str, tweak: str, inverse: bool) -> str:
    """Each letter and digit of ``value`` moved within its class by a keystream of ``other`` (32 steps, then again)."""
    said = f"concat({key}, '|', '{tweak}', '|', r, '|%d|', {other})"
    stream = f"concat(sha2({said % 0}, 256), sha2({said % 1}, 256))"

    def moved(first: str, size: int) -> str:
        step = f"pmod(ascii(x.c) - ascii('{first}') {'-' if inverse else '+'} x.d, {size})"
        return f"chr(ascii('{first}') + {step})"

    step = "cast(conv(substr(k, pmod(i - 1, 32) * 4 + 1, 4), 16, 10) as int)"
    letters = f"transform(transform(sequence(1, length({value})), i -> named_struct('c', substr({value}, i, 1), 'd', {step.replace('(k,', f'({stream},')})), "
    letters += f"x -> case when x.c between '0' and '9' then {moved('0', 10)} when x.c between 'a' and 'z' then {moved('a', 26)} "
    letters += f"when x.c between 'A' and 'Z' then {moved('A', 26)} else x.c end)"
    return f"if(length({value}) = 0, '', array_join({letters}, ''))"


def feistel_text(value: str, key: str, tweak: str, inverse: bool = False) -> str:
    """SQL text of the permuted string; ``value`` and ``key`` are SQL texts."""
    half = f"cast(length({value}) div 2 as int)"
    start = f"named_struct('a', substr({value}, 1, {half}), 'b', substr({value}, {half} + 1))"
    even = f"named_struct('a', {_shifted('s.a', 's.b', key, tweak, inverse)}, 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', {_shifted('s.b', 's.a', key, tweak, inverse)})"
    return f"aggregate({_order(inverse)}, {start}, (s, r) -> if(r % 2 = 0, {even}, {odd}), s -> concat(s.a, s.b))"


def feistel_number(value: str, a: int, b: int, key: str, tweak: str, inverse: bool = False) -> str:
    """SQL text of a permutation of 0 .. a * b - 1."""

    def step(other: str) -> str:
        return f"cast(conv(substr(sha2(concat({key}, '|', '{tweak}', '|', r, '|', {other}), 256), 1, 14), 16, 10) as bigint)"

    sign = "-" if inverse else "+"
    start = f"named_struct('a', cast({value} as bigint) div {b}, 'b', pmod(cast({value} as bigint), {b}L))"
    even = f"named_struct('a', pmod(s.a {sign} {step('s.b')}, {a}L), 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', pmod(s.b {sign} {step('s.a')}, {b}L))"
    return f"aggregate({_order(inverse)}, {start}, (s, r) -> if(r % 2 = 0, {even}, {odd}), s -> s.a * {b} + s.b)"


def _luhn_sum(digits: str, own: int) -> str:
    """Sum of the digits from the right, every second one doubled; ``own``: 0 if the last digit is a check digit, 1 if it is to come."""
    digit = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + if(pmod(i + {own}, 2) = 0, {digit}, {digit} * 2 - if({digit} > 4, 9, 0)))"


def _refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    place = "length(regexp_replace(substr({0}, 1, j), '[^0-9]', ''))".format(shape)
    return f"array_join(transform(sequence(1, length({shape})), j -> if(substr({shape}, j, 1) between '0' and '9', substr({digits}, {place}, 1), substr({shape}, j, 1))), '')"


def pseudonym(m: str, key: str, inverse: bool = False) -> str:
    """SQL text of (kind, text) for one find ``m``; the kind is null if it isn't valid."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    low = f"lower({m})"
    name, domain = f"substring_index({low}, '@', 1)", f"substring_index({low}, '@', -1)"
    last = f"substring_index({domain}, '.', -1)"
    host = f"substr({domain}, 1, length({domain}) - length({last}) - 1)"
    email = f"concat({feistel_text(name, key, 'name', inverse)}, '@', {feistel_text(host, key, 'host', inverse)}, '.', {last})"

    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    number = f"aggregate({octets}, 0L, (t, o) -> t * 256 + o)"
    swapped = feistel_number(number, 65536, 65536, key, "ip", inverse)
    ip = f"array_join(transform(array(24, 16, 8, 0), z -> cast(shiftright(n.v, z) & 255 as string)), '.')"
    ip = f"element_at(transform(array(named_struct('v', {swapped})), n -> {ip}), 1)"

    day = f"datediff(try_to_timestamp({m}, 'yyyy-MM-dd'), date'1800-01-01')"
    date = f"date_format(date_add(date'1800-01-01', cast({feistel_number(day, 189, 773, key, 'date', inverse)} as int)), 'yyyy-MM-dd')"

    body = f"substr({digits}, 1, length({digits}) - 1)"
    own = f"transform(array({feistel_text(body, key, 'card', inverse)}), b -> concat(b, cast(pmod(10 - pmod({_luhn_sum('b', 1)}, 10), 10) as string)))"
    card = f"element_at(transform({own}, f -> {_refilled(m, 'f')}), 1)"

    kept = f"substr({digits}, 1, greatest(length({digits}) - 10, 0))"
    rest = f"substr({digits}, greatest(length({digits}) - 10, 0) + 1)"
    phone = f"element_at(transform(array(concat({kept}, {feistel_text(rest, key, 'phone', inverse)})), f -> {_refilled(m, 'f')}), 1)"

    whole = lambda p: f"{m} rlike {_quoted('^(?:' + p + ')$')}"
    cases = [
        (f"contains({m}, '@')", "email", email),
        (f"{whole('[0-9]{1,3}(?:[.][0-9]{1,3}){3}')} and forall({octets}, o -> o <= 255)", "ip", ip),
        (f"{whole('[0-9]{4}-[0-9]{2}-[0-9]{2}')} and coalesce({day} between 0 and 146096, false)", "date", date),
        (f"{whole(_CARD)} and pmod({_luhn_sum(digits, 0)}, 10) = 0", "card", card),
        (f"not ({whole(_CARD)} or {whole('[0-9]{4}-[0-9]{2}-[0-9]{2}')} or {whole('[0-9]{1,3}(?:[.][0-9]{1,3}){3}')}) and length({digits}) between 10 and 15", "phone", phone),
    ]
    said = " ".join(f"when {test} then named_struct('kind', '{kind}', 'text', {value})" for test, kind, value in cases)
    return f"case {said} else named_struct('kind', cast(null as string), 'text', {m}) end"


def pseudonymise(docs: DataFrame, key: str, text: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with the text rewritten and ``pii_kinds``, the kinds of the values replaced in their order."""
    names = [c for c in docs.columns if c not in ("pii_kinds", "_finds")]
    pattern, column = _quoted(PATTERN), f"`{text}`"
    found = F.expr(f"if({column} rlike '[0-9@]', transform(regexp_extract_all({column}, {pattern}, 0), m -> {pseudonym('m', _quoted(key), inverse)}), array())")
    pieces = f"zip_with(split({column}, {pattern}, -1), _finds, (p, f) -> concat(p, coalesce(f.text, '')))"
    new = F.expr(f"if(size(_finds) > 0, array_join({pieces}, ''), {column})")
    kinds = F.expr("coalesce(transform(filter(_finds, f -> f.kind is not null), f -> f.kind), array())")
    marked = docs.select(*names, found.alias("_finds"))
    return marked.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in names), kinds.alias("pii_kinds"))
