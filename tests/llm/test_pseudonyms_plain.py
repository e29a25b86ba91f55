"""Pseudonyms of whole texts against a plain rewrite of them with Python's hmac; the key stays out of plans; nothing stays itself."""

import datetime
import hashlib
import hmac
import re
import string

import pytest

from lodestone.llm import pii

from .test_brute_force import SF, luhn, replaced

KEY, ROUNDS = "a plain test key", 8


def drawn(*parts):
    return int(hmac.new(KEY.encode(), "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()[:15], 16)


def numbers(tweak, left, right, a, b):
    def turn(x, y, k, sign):
        return ((x + sign * drawn(tweak, k, y)) % a, y) if k % 2 else (x, (y + sign * drawn(tweak, k, x)) % b)

    for k in range(1, ROUNDS + 1):
        left, right = turn(left, right, k, 1)
    left = (left + 1) % a
    for k in range(ROUNDS, 0, -1):
        left, right = turn(left, right, k, -1)
    return left, right


def characters(tweak, value, classes=(string.digits, string.ascii_uppercase, string.ascii_lowercase)):
    def shift(c, by):
        x = next(x for x in classes if c in x)
        return x[(x.index(c) + by) % len(x)]

    if len(value) < 2:
        if not value:
            return value
        x = next(x for x in classes if value in x)
        ring = sorted(x, key=lambda c: (drawn(tweak + " ring", c), c))
        return ring[(ring.index(value) + 1) % len(ring)]
    half = (len(value) + 1) // 2
    left, right = value[:half], value[half:]

    sizes = len(left), len(right)

    def turn(x, y, k, sign):
        return "".join(shift(c, sign * drawn(tweak, k, i, *sizes, y)) for i, c in enumerate(x))

    for k, sign in [*((k, 1) for k in range(1, ROUNDS + 1)), (0, 0), *((k, -1) for k in range(ROUNDS, 0, -1))]:
        if not k:
            left = shift(left[0], 1) + left[1:]
        elif k % 2:
            left = turn(left, right, k, sign)
        else:
            right = turn(right, left, k, sign)
    return left + right


def refilled(old, fresh, inside):
    fresh = iter(fresh)
    return "".join(next(fresh) if c in inside else c for c in old)


def alnum(c):
    return c in string.ascii_letters + string.digits


def check_digit(p):
    return next(d for d in string.digits if luhn(p + d))


def email(h):
    name, host = h.split("@")
    return refilled(name, characters("email", "".join(filter(alnum, name))), string.ascii_letters + string.digits) + "@" + host


def ip(h):
    q = [int(x) for x in h.split(".")]
    if max(q) > 255:
        return h
    a, b = numbers("ip", q[0] * 256 + q[1], q[2] * 256 + q[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def ipv6(h):
    n = sum(x != "" for x in h.split(":"))
    if not (n == 8 or "::" in h and n < 8):
        return h
    new = refilled(h, characters("ipv6", h.lower().replace(":", ""), (string.digits + "abcdef",)), string.hexdigits)
    return new.upper() if h == h.upper() else new


def mod97(p):
    return int("".join(str(int(c, 36)) for c in p)) % 97


def iban(h):
    g = h.replace(" ", "")
    if not 15 <= len(g) <= 34 or mod97(g[4:] + g[:4]) != 1:
        return h
    b = characters("iban", g[4:])
    return refilled(h, f"{g[:2]}{98 - mod97(b + g[:2] + '00'):02}{b}", string.ascii_uppercase + string.digits)


def phone(h):
    g = re.sub(r"\D", "", h)
    two = {20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98}
    size = 0 if h[0] != "+" else 1 if g[0] in "17" else 2 if int(g[:2]) in two else 3
    cc, n = g[:size], g[size:]
    if cc not in ("", "1") or len(n) != 10:
        return refilled(h, cc + characters("abroad", n), string.digits)
    if n[0] >= "2" and n[3] >= "2":
        a, b = numbers("phone", int(n[:3]) - 200, (int(n[3:6]) - 200) * 10000 + int(n[6:]), 800, 8_000_000)
        return refilled(h, f"{cc}{a + 200}{b // 10000 + 200}{b % 10000:04}", string.digits)
    if not cc:
        return h
    if n[0] < "2":
        a, b = numbers("phone area", int(n[:3]), int(n[3:]), 200, 10_000_000)
        return refilled(h, f"{cc}{a:03}{b:07}", string.digits)
    a, b = numbers("phone exchange", int(n[:3]) - 200, int(n[3:]), 800, 2_000_000)
    return refilled(h, f"{cc}{a + 200:03}{b:07}", string.digits)


def ssn(h):
    a, b, c = map(int, h.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return h
    x, y = numbers("ssn", a - (2 if a > 666 else 1), (b - 1) * 9999 + c - 1, 898, 99 * 9999)
    return f"{x + (2 if x >= 665 else 1):03}-{y // 9999 + 1:02}-{y % 9999 + 1:04}"


def date(h):
    layout = "%Y-%m-%d" if h[4] == "-" else "%Y/%m/%d" if h[4] == "/" else "%d.%m.%Y" if "." in h else "%d/%m/%Y"
    try:
        day = datetime.datetime.strptime(h, layout).date()
    except ValueError:
        return h
    n, first = (day - datetime.date(1900, 1, 1)).days, datetime.date(1900, 1, 1)
    if 0 <= n < 73000:
        a, b = numbers("date", n // 292, n % 292, 250, 292)
        n = a * 292 + b
    elif 73000 <= n < 73049:
        a, b = numbers("late", (n - 73000) // 7, (n - 73000) % 7, 7, 7)
        n = 73000 + a * 7 + b
    else:
        return h
    return (first + datetime.timedelta(days=n)).strftime(layout)


def card(h):
    g = re.sub(r"\D", "", h)
    if not luhn(g):
        return h
    p = characters("card", g[:-1])
    return refilled(h, p + check_digit(p), string.digits)


MAKERS = {"email": email, "ip": ip, "ipv6": ipv6, "iban": iban, "phone": phone, "ssn": ssn, "date": date, "card": card}


def plain(text):
    """The text from left to right: at each place the first kind that matches, cards only where they hold."""
    patterns = {k: re.compile(p, re.A) for k, p in pii.PATTERNS.items()}
    shorter = [re.compile(rf"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){{{n - 1}}}(?![A-Za-z0-9])", re.A) for n in range(19, 12, -1)]
    out, at = "", 0
    while at < len(text):
        for kind, make in MAKERS.items():
            found = [p.match(text, at) for p in shorter] if kind == "card" else [patterns[kind].match(text, at)]
            m = next((m for m in found if m and (kind != "card" or luhn(m.group()))), None)
            if m:
                out += make(m.group())
                at = m.end()
                break
        else:
            out += text[at]
            at += 1
    return out


TEXTS = [
    "a@x.org b@x.org ab@x.org a.b-c_1@mail.example.com ...@x.org call +49 30 1234567, +33 1 23 45 67 89; +1 415 5552671 +441632960961 (415) 555-2671 +7 (495) 123-45-67",
    "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 GB82WEST12345698765433 2001:db8::ff00:42:8329 fe80::1 12:30:45 std::vector 2001:0DB8:0000:0000:0000:FF00:0042:8329 1::2::3",
    "4111111111111111 190.137.223.204 999.1.1.1 123-45-6789 000-11-2222 2024-02-29 31.12.2099 2099-11-20 1900/01/01 30.02.2001 14/07/1989 4012-8888-8888-1881",
    "+1 (017) 555-7713 +1 415.155.0000 +1 (212) 555-0000 +999 12345 +12", "", "no numbers at all",
]


def test_whole_texts(spark):
    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = TEXTS + docs
    got = replaced(spark, texts, KEY)
    for text, new in zip(texts, got):
        assert new == plain(text)
    assert sum(a != b for a, b in zip(texts, got)) > 10


def test_nothing_stays_itself(spark):
    for names in (string.ascii_lowercase, string.ascii_uppercase, string.digits):
        for key in ("k2", "SECRETKEY", KEY):
            new = [x.split("@")[0] for x in replaced(spark, [f"{c}@x.org" for c in names], key)]
            assert sorted(new) == sorted(names) and all(a != b for a, b in zip(names, new))
            steps = {(ord(b) - ord(a)) % len(names) for a, b in zip(names, new)}
            assert len(steps) > 2  # no constant shift
    pairs = [f"{a}{b}@x.org" for a in string.ascii_lowercase for b in string.ascii_lowercase]
    new = replaced(spark, pairs)
    assert sorted(new) == sorted(pairs) and all(a != b for a, b in zip(pairs, new))
    late = [(datetime.date(2099, 11, 13) + datetime.timedelta(days=k)).isoformat() for k in range(49)]
    new = replaced(spark, late)
    assert sorted(new) == late and all(a != b for a, b in zip(late, new))


@pytest.mark.parametrize("rows", [False, True])
def test_the_key_is_in_no_plan(spark, rows):
    df = spark.createDataFrame([(1, "a@x.org")], "doc_id long, text string")
    out = (pii.pseudonymised_rows if rows else pii.pseudonymise)(df, "very-secret-key")
    told = out._jdf.queryExecution().toString() + out._jdf.queryExecution().logical().toJSON() + out._jdf.queryExecution().executedPlan().toJSON()
    assert "very-secret-key" not in told and out.count() == 1
