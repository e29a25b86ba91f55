"""Format-preserving Feistel pseudonyms for validated numbers and dates, in SQL expressions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import key_and_text

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31: 73000 = 250 * 292 of them, then 49 = 7 * 7.
FIRST_DAY, DAYS, TAIL = "1900-01-01", (250, 292), (7, 7)

_LOW, _HIGH = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
#: Candidates by kind, tried in this order at each place of a text; a candidate that isn't valid stays as it is. Those
#: for cards may be shorter, by whole groups of digits: the longest that is valid counts, none hides what lies in it.
#: A domain's labels are matched possessively, as a loop: one that may give labels back takes a stack frame for each.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "ipv6": r"(?<![A-Za-z0-9:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![A-Za-z0-9:]|\.[0-9])",
    "iban": _LOW + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _HIGH,
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9](?:[ .-]?\(?[0-9]\)?){6,14})" + _HIGH,
    "ssn": _LOW + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _HIGH,
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])",
    "card": _LOW + r"[0-9](?:[ -]?[0-9]){12,18}" + _HIGH,
}
ANY = "|".join(PATTERNS.values())
#: All but the cards, and the longest candidate for a card from each group of digits on.
OTHERS = "|".join(pattern for kind, pattern in PATTERNS.items() if kind != "card")
FROM_EACH_GROUP = f"{_LOW}(?=({PATTERNS['card'].removeprefix(_LOW).removesuffix(_HIGH)}){_HIGH})"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _keyed(tweak: str, *parts: str) -> str:
    """SQL of HMAC-SHA256 of the parts, as a number of 60 bits. The key is in the columns of `keys`."""
    message = f"CAST(concat_ws('|', {tweak}, {', '.join(parts)}) AS binary)"
    return f"CAST(conv(substr(sha2(concat(_outer, unhex(sha2(concat(_inner, {message}), 256))), 256), 1, 15), 16, 10) AS bigint)"


def keys(spark: SparkSession, key: str) -> DataFrame:
    """A table of one row with the two blocks of HMAC. The key is data of this table, so no plan or event log shows it."""
    raw = key.encode("utf-8")
    block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    row = [(bytearray(x ^ 0x36 for x in block), bytearray(x ^ 0x5C for x in block))]
    return spark.createDataFrame(row, "_inner binary, _outer binary")


# A permutation without a value that stays: a Feistel network, one step, and the network backwards. What moves no value
# in the middle moves none at the ends. STEPS counts the rounds there, the step and the rounds back.
STEPS, STEP = 2 * ROUNDS + 1, ROUNDS + 1
_ROUND, _SIGN = f"IF(k < {STEP}, k, {STEPS + 1} - k)", f"IF(k < {STEP}, 1, -1)"


def _with(bindings: dict[str, str], body: str) -> str:
    """SQL of `body` with names bound to values once each (a lambda over an array of one element)."""
    for name, value in reversed(bindings.items()):
        body = f"transform(array({value}), {name} -> {body})[0]"
    return body


def _numbers() -> str:
    """SQL of struct<l, r>: x's pair (l below a, r below b) moved by a network of modular additions."""

    def moved(half: str, other: str, n: str) -> str:
        return f"({half} + {_SIGN} * ({_keyed('x.tweak', _ROUND, other)} % {n}) + {n}) % {n}"

    return (
        f"aggregate(sequence(1, {STEPS}), struct(x.l AS l, x.r AS r), (s, k) -> CASE WHEN k = {STEP} THEN struct((s.l + 1) % x.a AS l, s.r AS r)"
        f" WHEN {_ROUND} % 2 = 1 THEN struct({moved('s.l', 's.r', 'x.a')} AS l, s.r AS r) ELSE struct(s.l AS l, {moved('s.r', 's.l', 'x.b')} AS r) END)"
    )


#: Fixed: the classes of characters that move, each within its own; those of an IPv6 address are one class.
CLASS = "CASE WHEN x.kind = 'ipv6' THEN '0123456789abcdef' WHEN {c} < 'A' THEN '0123456789' WHEN {c} < 'a' THEN 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' ELSE 'abcdefghijklmnopqrstuvwxyz' END"


def _characters() -> str:
    """SQL of x.v (of characters of the classes alone) moved by a network on its halves, each character within its class.

    One character alone goes to the next on a ring of its class in an order that the key makes.
    """

    def by(c: str, amount: str) -> str:
        return _with({"al": CLASS.format(c=c)}, f"substr(al, CAST((instr(al, {c}) - 1 + {amount} + length(al)) % length(al) AS int) + 1, 1)")

    def moved(half: str, other: str) -> str:
        drawn = _keyed("x.tweak", _ROUND, "i", "length(s.l)", "length(s.r)", other)
        return f"array_join(transform(split({half}, ''), (c, i) -> {by('c', f'{_SIGN} * ({drawn} % length(al))')}), '')"

    ring = f"transform(array_sort(transform(split({CLASS.format(c='x.v')}, ''), c -> struct({_keyed('concat(x.tweak, \' ring\')', 'c')} AS at, c AS c))), p -> p.c)"
    alone = _with({"ring": ring}, "ring[CAST(array_position(ring, x.v) % size(ring) AS int)]")
    step = f"concat({by('substr(s.l, 1, 1)', '1')}, substr(s.l, 2))"
    network = (
        f"aggregate(sequence(1, {STEPS}), struct(substr(x.v, 1, (length(x.v) + 1) div 2) AS l, substr(x.v, (length(x.v) + 1) div 2 + 1) AS r), (s, k) -> CASE WHEN k = {STEP} THEN struct({step} AS l, s.r AS r)"
        f" WHEN {_ROUND} % 2 = 1 THEN struct({moved('s.l', 's.r')} AS l, s.r AS r) ELSE struct(s.l AS l, {moved('s.r', 's.l')} AS r) END, s -> concat(s.l, s.r))"
    )
    return f"CASE WHEN length(x.v) < 1 THEN x.v WHEN length(x.v) = 1 THEN {alone} ELSE {network} END"


#: The digit that makes a number valid by Luhn's rule when put after `p`.
_LUHN = "CAST((10 - aggregate(split(reverse(p), ''), struct(0L AS n, 0 AS i), (a, c) -> struct(a.n + CASE WHEN a.i % 2 = 0 THEN (CAST(c AS int) * 2) div 10 + (CAST(c AS int) * 2) % 10 ELSE CAST(c AS int) END AS n, a.i + 1 AS i)).n % 10) % 10 AS string)"


def _valid(g: str) -> str:
    """SQL of whether the digits hold by Luhn's rule."""
    return f"{_with({'p': f'substr({g}, 1, length({g}) - 1)'}, _LUHN)} = right({g}, 1)"


def _cards() -> str:
    """SQL of the valid cards of `text`, each of whole groups of 13 to 19 digits, with separators as they stand."""
    shorter = ", ".join(f"regexp_extract(w, '^[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![0-9])', 0)" for n in range(13, 20))
    windows = f"array_distinct(flatten(transform(regexp_extract_all(text, {_sql(FROM_EACH_GROUP)}, 1), w -> array({shorter}))))"
    return f"filter({windows}, c -> c <> '' AND {_with({'g': 'regexp_replace(c, \'[^0-9]\', \'\')'}, _valid('g'))})"


#: The remainder by 97 of the characters of `p` as an account's standard reads them, letters being 10 to 35.
_MOD97 = "aggregate(split(p, ''), 0, (a, c) -> CASE WHEN c BETWEEN '0' AND '9' THEN (a * 10 + CAST(c AS int)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END)"


#: Fixed: country codes of one and two digits; the others have three.
COUNTRIES = "^(?:[17]|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _parsed() -> str:
    """SQL of what is to move in the candidate h: struct<kind, tweak, pre, v, l, r, a, b>, its kind empty if it isn't valid.

    Either the characters v or the numbers l and r (below a and b; a is 0 if there are none) move; pre stays.
    """

    def values(kind: str, tweak: str, pre: str, v: str, *pair: str) -> str:
        numbers = ", ".join(f"CAST({x} AS bigint) AS {n}" for n, x in zip("lrab", pair or "0000"))
        return f"struct('{kind}' AS kind, '{tweak}' AS tweak, {pre} AS pre, {v} AS v, {numbers})"

    none = values("", "", "''", "''")
    area = "CAST(substr(h, 1, 3) AS int)"
    main = DAYS[0] * DAYS[1]
    number = "CAST(datediff(try_cast(CASE WHEN h LIKE '____-%' OR h LIKE '____/%' THEN replace(h, '/', '-') ELSE concat_ws('-', substr(h, 7), substr(h, 4, 2), substr(h, 1, 2)) END AS date), DATE '" + FIRST_DAY + "') AS bigint)"
    kinds = {
        "email": values("email", "email", "substr(h, instr(h, '@'))", "regexp_replace(substring_index(h, '@', 1), '[^A-Za-z0-9]', '')"),
        "ip": _with({"q": "transform(split(h, '[.]'), y -> CAST(y AS int))"}, f"IF(array_max(q) < 256, {values('ip', 'ip', '\'\'', '\'\'', 'q[0] * 256 + q[1]', 'q[2] * 256 + q[3]', '65536', '65536')}, {none})"),
        "ipv6": _with({"n": "size(filter(split(h, ':'), y -> y <> ''))"}, f"IF(n = 8 OR h LIKE '%::%' AND n < 8, {values('ipv6', 'ipv6', '\'\'', 'replace(lower(h), \':\', \'\')')}, {none})"),
        "iban": _with(
            {"g": "replace(h, ' ', '')", "holds": _with({"p": "concat(substr(g, 5), substr(g, 1, 4))"}, f"{_MOD97} = 1")},
            f"IF(length(g) BETWEEN 15 AND 34 AND holds, {values('iban', 'iban', 'substr(g, 1, 2)', 'substr(g, 5)')}, {none})",
        ),
        "phone": _with(
            {"g": "regexp_replace(h, '[^0-9]', '')", "cc": f"IF(h LIKE '+%', regexp_extract(g, '{COUNTRIES}', 0), '')", "n": "substr(g, length(cc) + 1)"},
            f"CASE WHEN cc NOT IN ('', '1') OR length(n) <> 10 THEN {values('phone', 'abroad', 'cc', 'n')}"
            f" WHEN substr(n, 1, 1) >= '2' AND substr(n, 4, 1) >= '2' THEN {values('phone', 'phone', 'cc', '\'\'', 'CAST(substr(n, 1, 3) AS int) - 200', '(CAST(substr(n, 4, 3) AS int) - 200) * 10000 + CAST(substr(n, 7) AS int)', '800', '8000000')}"
            # Outside the plan: an area below 200, or else an exchange below 200; each keeps to its own kind.
            f" WHEN cc = '' THEN {none} WHEN substr(n, 1, 1) < '2' THEN {values('phone', 'phone area', 'cc', '\'\'', 'CAST(substr(n, 1, 3) AS int)', 'CAST(substr(n, 4) AS int)', '200', '10000000')}"
            f" ELSE {values('phone', 'phone exchange', 'cc', '\'\'', 'CAST(substr(n, 1, 3) AS int) - 200', 'CAST(substr(n, 4) AS int)', '800', '2000000')} END",
        ),
        # Areas 001 to 899 without 666 are 898 numbers; groups 01 to 99, serials 0001 to 9999.
        "ssn": f"IF({area} NOT IN (0, 666) AND {area} < 900 AND substr(h, 5, 2) <> '00' AND substr(h, 8) <> '0000', {values('ssn', 'ssn', '\'\'', '\'\'', f'{area} - IF({area} > 666, 2, 1)', '(CAST(substr(h, 5, 2) AS int) - 1) * 9999 + CAST(substr(h, 8) AS int) - 1', '898', str(99 * 9999))}, {none})",
        "date": _with(
            {"n": number},
            f"CASE WHEN n BETWEEN 0 AND {main - 1} THEN {values('date', 'date', '\'\'', '\'\'', f'n div {DAYS[1]}', f'n % {DAYS[1]}', *map(str, DAYS))}"
            f" WHEN n BETWEEN {main} AND {main + TAIL[0] * TAIL[1] - 1} THEN {values('date', 'late', '\'\'', '\'\'', f'(n - {main}) div {TAIL[1]}', f'(n - {main}) % {TAIL[1]}', *map(str, TAIL))} ELSE {none} END",
        ),
        "card": _with({"g": "regexp_replace(h, '[^0-9]', '')"}, f"IF({_valid('g')}, {values('card', 'card', '\'\'', 'substr(g, 1, length(g) - 1)')}, {none})"),
    }
    return "CASE " + " ".join(f"WHEN h rlike {_sql('^(?:' + PATTERNS[kind] + ')$')} THEN {sql}" for kind, sql in kinds.items()) + f" ELSE {none} END"


def _written() -> str:
    """SQL of the pseudonym of h from what moved: the string w and the numbers f."""
    number = "lpad(CAST({} AS string), {}, '0')"
    phone = (
        f"CASE x.tweak WHEN 'abroad' THEN w WHEN 'phone' THEN concat(CAST(f.l + 200 AS string), CAST(f.r div 10000 + 200 AS string), {number.format('f.r % 10000', 4)})"
        f" ELSE concat({number.format('f.l + IF(x.tweak = \'phone area\', 0, 200)', 3)}, {number.format('f.r', 7)}) END"
    )
    fresh = (
        f"CASE x.kind WHEN 'email' THEN w WHEN 'ipv6' THEN IF(h = upper(h), upper(w), w) WHEN 'phone' THEN concat(x.pre, {phone})"
        f" WHEN 'card' THEN concat(w, {_with({'p': 'w'}, _LUHN)})"
        f" WHEN 'iban' THEN concat(x.pre, {_with({'p': 'concat(w, x.pre, \'00\')'}, number.format(f'98 - {_MOD97}', 2))}, w) END"
    )
    # The characters go where the old ones stood, in order; all else stays in place.
    refilled = _with(
        {"d": fresh},
        "aggregate(split(IF(x.kind = 'email', substring_index(h, '@', 1), h), ''), struct('' AS t, 1 AS i), (a, c) -> CASE WHEN c rlike '[A-Za-z0-9]' THEN struct(concat(a.t, substr(d, a.i, 1)) AS t, a.i + 1 AS i) ELSE struct(concat(a.t, c) AS t, a.i AS i) END, a -> a.t)",
    )
    main = DAYS[0] * DAYS[1]
    day = f"CAST(date_add(DATE '{FIRST_DAY}', CAST(IF(x.tweak = 'date', f.l * {DAYS[1]} + f.r, {main} + f.l * {TAIL[1]} + f.r) AS int)) AS string)"
    date = _with({"d": day}, "CASE WHEN h LIKE '____-%' THEN d WHEN h LIKE '____/%' THEN replace(d, '-', '/') ELSE concat_ws(substr(h, 3, 1), substr(d, 9), substr(d, 6, 2), substr(d, 1, 4)) END")
    return (
        f"CASE x.kind WHEN '' THEN h WHEN 'ip' THEN concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256) WHEN 'date' THEN {date}"
        f" WHEN 'ssn' THEN concat_ws('-', {number.format('f.l + IF(f.l >= 665, 2, 1)', 3)}, {number.format('f.r div 9999 + 1', 2)}, {number.format('f.r % 9999 + 1', 4)})"
        f" ELSE concat({refilled}, IF(x.kind = 'email', x.pre, '')) END"
    )


def _pseudonymised() -> Column:
    """struct<text, hits array<struct<kind, was, now>>> of the column `text` by the key beside it; null for a text without candidates."""
    # The text's own cards, each before its shorter beginnings, are what the pattern has for cards.
    pattern = f"CASE WHEN size(cards) = 0 THEN {_sql(OTHERS)} ELSE concat({_sql(f'{OTHERS}|{_LOW}(?:')}, array_join(sort_array(cards, false), '|'), {_sql(f'){_HIGH}')}) END"
    # One network for all kinds of characters and one for all numbers keep the plan small.
    hit = _with({"x": _parsed(), "w": _characters(), "f": f"IF(x.a > 0, {_numbers()}, struct(0L AS l, 0L AS r))"}, f"struct(x.kind AS kind, h AS was, {_written()} AS now)")
    hits = f"transform(regexp_extract_all(text, pattern, 0), h -> {hit})"
    whole = "struct(array_join(zip_with(split(text, pattern), hits, (piece, hit) -> concat(piece, coalesce(hit.now, ''))), '') AS text, filter(hits, x -> x.was <> x.now) AS hits)"
    # A candidate has an at sign, two colons or seven digits, if not in a row; other texts are not searched.
    return F.expr(f"CASE WHEN text rlike '@|::|[0-9][^A-Za-z]*[0-9]' AND text rlike {_sql(ANY)} THEN {_with({'cards': _cards(), 'pattern': pattern, 'hits': hits}, whole)} END")


def pseudonymise(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced (long) and hits (kind, was, now) of every row.

    Emails (the name before the at sign), IPv4 and IPv6 addresses, IBANs whose check digits hold, telephone numbers
    (with a country code any of 7 to 15 digits; +1 numbers of the North American plan and others each within their kind;
    without a code only those of the plan), social security numbers, card numbers (13 to 19 digits in whole groups) that
    hold by Luhn's rule, and dates from 1900 to 2099 (year first, or day first with dots or slashes) are permuted by
    Feistel networks, keyed by HMAC, within their kind: the layout stays, the outcome is valid again (of an IBAN its own
    check digits, not those of a country inside it), equal values get equal pseudonyms in all documents, different ones
    different pseudonyms, and none stays itself but a mail name without letters and digits. Numbers that are not valid
    stay as they are. One row at a time in SQL expressions, the key from a broadcast table of one row: no shuffle, no
    Python. A null text stays null, an empty one empty; a null doc_id stays null; repeated rows are treated each; an
    empty table gives no rows; other columns are not read.
    """
    texts = key_and_text(df, id_col, text_col).crossJoin(F.broadcast(keys(df.sparkSession, key)))
    found = texts.select("doc_id", "text", _pseudonymised().alias("new"))
    return found.select("doc_id", F.expr("coalesce(new.text, text)").alias("text"), F.expr("CAST(coalesce(size(new.hits), 0) AS bigint)").alias("n_replaced"), F.expr("coalesce(new.hits, CAST(array() AS array<struct<kind: string, was: string, now: string>>))").alias("hits"))


def pseudonymised_rows(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of `df`, with all columns in their order, and pseudonyms in the text column; nulls as in `pseudonymise`."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole"), F.col(text_col).cast("string").alias("text"))
    new = whole.crossJoin(F.broadcast(keys(df.sparkSession, key))).select("_whole", "text", _pseudonymised().alias("new"))
    return new.select(*[F.expr("coalesce(new.text, text)").alias(c) if c == text_col else F.col(f"_whole.`{c}`") for c in df.columns])
