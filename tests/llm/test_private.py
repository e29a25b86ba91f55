"""Private numbers beside other numbers, and telephone numbers outside the plan."""

import random
import re

import pytest

from .test_brute_force import luhn, replaced

CARD = "4111111111111111"


@pytest.mark.parametrize(
    ("text", "layout", "n"),
    [
        ("4111111111111111 123", r"(\d{16}) 123", 1),
        ("4111111111111111-12", r"(\d{16})-12", 1),
        ("12 4111 1111 1111 1111", r"12 (\d{4} \d{4} \d{4} \d{4})", 1),
        ("7 4111-1111-1111-1111 9 and 5", r"7 (\d{4}-\d{4}-\d{4}-\d{4}) 9 and 5", 1),
        ("4111111111111111 4012888888881881", r"(\d{16}) (\d{16})", 2),
        ("4111111111111111 190.137.223.204", r"(\d{16}) (\d{1,3}(?:\.\d{1,3}){3})", 2),
        ("4111111111111111 415-555-2671", r"(\d{16}) (\d{3}-\d{3}-\d{4})", 2),
        ("1234567 123-45-6789", r"1234567 (\d{3}-\d{2}-\d{4})", 1),
        ("4111111111111111 123@host.org", r"(\d{16}) (\d{3}@host\.org)", 2),
    ],
)
def test_cards_beside_numbers(spark, text, layout, n):
    (new,) = replaced(spark, [f"see {text}, x"])
    old, now = re.fullmatch(layout, text).groups(), re.fullmatch(f"see {layout}, x", new).groups()
    assert len(now) == n and all(a != b for a, b in zip(old, now))
    assert all(luhn(b) for a, b in zip(old, now) if len(re.sub(r"\D", "", a)) == 16)


def test_numbers_without_cards(spark):
    rng = random.Random(3)
    same = ["4111111111111112 123", "12 4111 1111 1111 1112", CARD + "1234", f"x{CARD} 123", " ".join(["1"] * 12), "4" * 30]
    assert replaced(spark, same) == same
    long = " ".join(str(rng.randrange(10**5)) for _ in range(5_000))
    (new,) = replaced(spark, [long])
    assert len(new) == len(long) and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", long) and new != long


def test_phones_outside_the_plan(spark):
    rng = random.Random(5)
    low = [f"+1 ({rng.randrange(200):03}) {rng.randrange(1000):03}-{rng.randrange(10**4):04}" for _ in range(100)]
    low += [f"+1 {rng.randrange(200, 1000)}.{rng.randrange(200):03}.{rng.randrange(10**4):04}" for _ in range(100)] + ["+1 (017) 555-7713"]
    new = replaced(spark, [f"call {x}." for x in low])
    assert len(set(new)) == len(set(low)) and all(f"call {a}." != b for a, b in zip(low, new))
    for a, b in zip(low, new):
        assert re.fullmatch(r"call \+1 \([01]\d\d\) \d{3}-\d{4}\." if "(" in a else r"call \+1 [2-9]\d\d\.[01]\d\d\.\d{4}\.", b)


def test_long_domains(spark):
    """A mail address may have any number of domain labels; none takes a stack frame for each."""
    long = "ann.lee@" + "a." * 100_000 + "com"
    (new,) = replaced(spark, [f"write {long}, then"])
    assert re.fullmatch(r"write [a-z]{3}\.[a-z]{3}@(?:a\.){100000}com, then", new) and "ann.lee@" not in new
    assert replaced(spark, ["a@" + "b." * 50_000 + "."])[0].startswith("a@b.") is False
