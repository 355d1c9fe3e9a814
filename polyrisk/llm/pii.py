"""Keyed format-preserving pseudonyms for personal data (DataFrame functions only).

Each kind of value is permuted within its own format by a balanced or mixed
Feistel network whose round function is SHA-256 of a key, the round and the
other half.  A permutation never maps two values to one, and equal values get
equal pseudonyms in all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Possessive, as nothing follows: the labels of a host are matched in a loop, however many there are.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)++"
#: With a country code: groups of digits (at least eight in all), or all digits in one.
WORLD_PHONE = r"(?=\+(?:[ .()-]{0,3}\d){8})\+\d{1,3}(?:[ .-]?\(\d{1,4}\)[ .-]?|[ .-])\d{1,12}(?:[ .-]\d{2,8}){0,5}(?!\d)|\+\d{8,15}(?!\d)"
US_PHONE = r"(?<![\d-])(?<!\d\.)(?:1[-. ])?(?:\(\d{3}\)[ -]?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!-?\d)"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])"
SLASH_DATE = r"(?<![\d/])(?:\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4})(?![\d/])"
DOT_DATE = r"(?<![\d.])(?:\d{4}\.\d{1,2}\.\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4})(?!\.?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5}|(?:\d{4}[ -]){4}\d{3})(?![\d-])"
ANY = "|".join((EMAIL, WORLD_PHONE, DATE, SLASH_DATE, DOT_DATE, SSN, US_PHONE, IPV4, CARD))
#: Dates are permuted within their Gregorian cycle of 400 years: 146097 = 189 * 773 days, counted from here.
FIRST_DAY, DAYS = "1900-01-01", (189, 773)
#: What the cycles leave at both ends, as (first day, grid): the years 1 to 299 and 9900 to 9999.
ENDS = ((-4 * 146097 - 7 * 15601, (7, 15601)), (20 * 146097, (92, 397)))
#: Social security numbers: 898 areas (not 000, 666, 900-999) by 99 groups, 9999 serials.
AREA_GROUPS, SERIALS = 898 * 99, 9999


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _digest(key: str, kind: str, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string")).cast("binary"), 256)


def permute_numbers(x: Column, y: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Struct (x, y): a keyed permutation of the pairs with 0 <= x < a and 0 <= y < b."""

    def step(state: Column, turn: Column) -> Column:
        even = turn % 2 == 0
        digest = _digest(key, kind, turn, F.when(even, state["y"]).otherwise(state["x"]))
        word = F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")
        return F.struct(
            F.when(even, (state["x"] + word) % F.lit(a)).otherwise(state["x"]).cast("bigint").alias("x"),
            F.when(even, state["y"]).otherwise((state["y"] + word) % F.lit(b)).cast("bigint").alias("y"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")), step)


def _shift(half: Column, digest: Column) -> Column:
    """Move every digit and ASCII letter of ``half`` on within its class by the digest's bytes."""

    def move(c: Column, i: Column) -> Column:
        k = F.conv(F.substring(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        return (
            F.when(c.between("0", "9"), F.char((code - 48 + k) % 10 + 48))
            .when(c.between("a", "z"), F.char((code - 97 + k) % 26 + 97))
            .when(c.between("A", "Z"), F.char((code - 65 + k) % 26 + 65))
            .otherwise(c)
        )

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.split(half, ""), move), ""))


def permute_string(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings with ``value``'s pattern of digits, letters and other marks."""
    cut = F.floor(F.length(value) / 2).cast("int")

    def step(state: Column, turn: Column) -> Column:
        digest = _digest(key, kind, turn, state["r"])
        return F.struct(state["r"].alias("l"), _let(digest, lambda d: _shift(state["l"], d)).alias("r"))

    halves = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, step), lambda s: F.concat(s["l"], s["r"]))


def _refill(pattern: Column, digits: Column) -> Column:
    """``pattern`` with its digits replaced, in order, by ``digits``."""
    return F.array_join(
        F.transform(
            F.split(pattern, ""),
            lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(F.regexp_replace(F.substring(pattern, F.lit(1), i + 1), r"[^0-9]", "")), F.lit(1))).otherwise(c),
        ),
        "",
    )


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit counts once."""

    def add(total: Column, pair: Column) -> Column:
        d = pair["c"].cast("int") * (1 + pair["i"] % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    pairs = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(pairs, F.lit(0), add)


def _card(value: Column, key: str) -> Column:
    """Luhn-valid numbers keep length and grouping and stay valid; others are unchanged."""
    digits = F.regexp_replace(value, r"[^0-9]", "")

    def made(body: Column) -> Column:
        check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        return _refill(value, F.concat(body, check.cast("string")))

    body = permute_string(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return F.when(luhn_sum(digits) % 10 == 0, _let(body, made)).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    """The national digits are permuted; country code and layout stay.

    Where nothing parts the country code from the rest, its first digit stays.
    """
    code = F.regexp_extract(value, r"^(?:\+\d{1,3}(?=[ .(-])|\+\d|1(?=[-. ]))?", 0)
    return _let(
        F.struct(code.alias("code"), F.substring(value, F.length(code) + 1, F.length(value)).alias("rest")),
        lambda v: F.concat(v["code"], _let(permute_string(F.regexp_replace(v["rest"], r"[^0-9]", ""), key, "phone"), lambda d: _refill(v["rest"], d))),
    )


def _ipv4(value: Column, key: str) -> Column:
    part = [F.split(value, r"\.")[i].cast("int") for i in range(4)]
    valid = part[0] <= 255
    for p in part[1:]:
        valid = valid & (p <= 255)
    moved = permute_numbers(part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536, key, "ipv4")
    return F.when(valid, _let(moved, lambda s: F.concat_ws(".", *((F.floor(s[h] / 256) if k == 0 else s[h] % 256).cast("string") for h in ("x", "y") for k in (0, 1))))).otherwise(value)


def _move_day(day: Column, key: str) -> Column:
    """A keyed permutation of the days of the years 1 to 9999, as days from ``FIRST_DAY``."""

    def moved(start: Column, grid: tuple[int, int], kind: str) -> Column:
        at = permute_numbers(F.floor((day - start) / grid[1]), (day - start) % grid[1], *grid, key, kind)
        return _let(at, lambda s: start + s["x"] * grid[1] + s["y"])

    (low, low_grid), (high, high_grid) = ENDS
    cycle = F.floor(day / (DAYS[0] * DAYS[1])) * (DAYS[0] * DAYS[1])
    return (
        F.when(day < low + low_grid[0] * low_grid[1], moved(F.lit(low), low_grid, "date-low"))
        .when(day >= high, moved(F.lit(high), high_grid, "date-high"))
        .otherwise(moved(cycle, DAYS, "date"))
        .cast("bigint")
    )


def _date(value: Column, key: str) -> Column:
    """Real days of the years 1 to 9999 move within their cycle of 400 years.

    Dates with the year last are read as day.month.year with dots and as
    month/day/year with slashes, or day/month/year where only that is a date.
    The latter move on until they land on such a date again, so that no two
    dates meet.  Days and months come out with two digits.
    """
    mark = F.regexp_extract(value, r"[-/.]", 0)
    part = F.split(value, r"[-/.]")
    iso = lambda y, m, d: F.try_to_date(F.concat_ws("-", part[y], F.lpad(part[m], 2, "0"), F.lpad(part[d], 2, "0")), "yyyy-MM-dd")
    year_first, dots = F.length(part[0]) == 4, mark == "."
    start = F.lit(FIRST_DAY).cast("date")
    us = iso(2, 0, 1)

    def write(day: Column, order: str) -> Column:
        made = F.date_format(F.date_add(start, day.cast("int")), "yyyy-MM-dd")
        first, second, third = (F.split(made, "-")["ymd".index(c)] for c in order)
        return F.concat(first, mark, second, mark, third)

    def made(date: Column, order: str) -> Column:
        return F.when(date.isNotNull(), _let(_move_day(F.datediff(date, start).cast("bigint"), key), lambda d: write(d, order))).otherwise(value)

    def walk(date: Column) -> Column:
        late = lambda day: F.dayofmonth(F.date_add(start, day.cast("int"))) > 12
        step = lambda day, turn: F.when((turn > 0) & late(day), day).otherwise(_move_day(day, key))
        end = F.aggregate(F.sequence(F.lit(0), F.lit(60)), F.datediff(date, start).cast("bigint"), step)
        return F.when(date.isNotNull(), _let(end, lambda d: write(d, "dmy"))).otherwise(value)

    return F.when(year_first, made(iso(0, 1, 2), "ymd")).when(dots, made(iso(2, 1, 0), "dmy")).when(us.isNotNull(), made(us, "mdy")).otherwise(walk(iso(2, 1, 0)))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.split(value, "-")[i].cast("int") for i in range(3))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    moved = permute_numbers(index * 99 + group - 1, serial - 1, AREA_GROUPS, SERIALS, key, "ssn")

    def made(s: Column) -> Column:
        k = F.floor(s["x"] / 99)
        return F.concat_ws("-", F.lpad(F.when(k >= 665, k + 2).otherwise(k + 1).cast("string"), 3, "0"), F.lpad((s["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((s["y"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(moved, made)).otherwise(value)


def _email(value: Column, key: str) -> Column:
    """Letters and digits of the local part are permuted; the domain stays."""
    at = F.instr(value, "@")
    return F.concat(permute_string(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.length(value)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match of ``ANY`` (the value itself where it isn't valid)."""
    return (
        F.when(value.contains("@"), _email(value, key))
        .when(value.startswith("+") | value.rlike(f"^(?:{US_PHONE})$"), _phone(value, key))
        .when(value.rlike(f"^(?:{DATE}|{SLASH_DATE}|{DOT_DATE})$"), _date(value, key))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(value, key))
        .when(value.contains("."), _ipv4(value, key))
        .otherwise(_card(value, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced; all other columns stay.

    Handled: e-mail addresses, phone numbers with a country code or in US
    layouts, IPv4 addresses, dates in digits with a year of four digits, US
    social security numbers and payment card numbers.  Numbers and dates are
    replaced only if valid (Luhn, octets, calendar, number ranges).  Text
    lengths stay, but for IPv4 addresses and for days and months of one digit.
    Null and empty texts stay; rows are independent of each other, so repeated
    rows, extra columns of any name and empty tables need no care.
    """
    name = "__found"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    text, matches = F.col(text_col), F.col(name)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    gaps = F.split(text, ANY, -1)
    # One gap more than matches: gap, pseudonym, gap, ..., gap.
    parts = F.transform(gaps, lambda g, i: F.when(i < F.size(matches), F.concat(g, pseudonym(F.get(matches, i), key))).otherwise(g))
    has = text.rlike("[0-9@]") & text.rlike(ANY)
    out = docs.withColumn(name, F.when(has, found))
    return out.withColumn(text_col, F.when(matches.isNull(), text).otherwise(F.array_join(parts, ""))).drop(name)
