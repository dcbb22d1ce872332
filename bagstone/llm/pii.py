"""Format-preserving pseudonyms for personal data, by keyed Feistel networks.

Values are found by pattern and validated: card numbers by the Luhn sum, phone
numbers by the North American numbering rules, social security numbers by their
reserved blocks, IPv4 octets and calendar dates by range. A valid value is
permuted within its own format, so the result is valid again: a card keeps its
first digit and gets a matching check digit, a date stays a date, an address
keeps its shape. e-mail addresses keep their domain and get a local part of the
same letters-and-digits shape. The same value has the same pseudonym in every
document, and different values different ones.

A number is split into two halves A in Z_a and B in Z_b; each round adds a
keyed hash of one half to the other, modulo its size. That is a permutation of
a x b values whatever the hash; with the rounds undone in reverse it gives the
value back. The hash is SHA-256 of key, kind, round and the other half. Where a
format has fewer values than that, a result outside is permuted again until it
is inside (cycle walking), which is a permutation of the values inside.

Dates of the years 0001 to 9999 move within their 400 years (0001-0400, ...,
9601-9999). A date written with its day first moves among all days; one that
only month first makes a date, so with a day from 13 on, among such days.

The key comes from the caller or from the session's setting
`spark.bagstone.pii.key`; there is no default, as whoever has the key can turn
pseudonyms back.

All of it is DataFrame functions: the text is split at the matches, each match
is mapped, and the parts are joined again; texts without a match pass
untouched.

Defined cases: a null text stays null with no values found; an empty one stays
empty. Values that fail validation are left as they are, the year 0000 among
them. A permutation may leave a value as it is, by chance; such a value isn't
counted as replaced. Repeated rows give one result row each. The result of
``pseudonymise`` has all input columns, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagstone.llm.common import fresh

ROUNDS = 10
KEY_SETTING = "spark.bagstone.pii.key"
MIN_KEY = 16

#: Patterns of the kinds, tried in this order at each place. Fixed values.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "ipv4": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "day": r"(?<![\d./])\d{2}[./]\d{2}[./]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}(?!\d)",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every value has one of these, and most texts have none.
HINT = "[0-9@]"
#: Days of a 400-year cycle of the calendar, 189 x 773, and of the years 9601 to 9999.
CYCLE, LAST = (189, 773), 145_731
FIRST_DAY = "0001-01-01"
#: Days after the 12th of their month in such a cycle, 9 x 9833, and in the last one.
LATE, LAST_LATE = (9, 9833), 88_275
#: The number of the last cycle.
FINAL = 24


def key_of(docs: DataFrame, key: str | None = None) -> str:
    """The key given, or the session's."""
    key = docs.sparkSession.conf.get(KEY_SETTING, None) if key is None else key
    if not key or len(key) < MIN_KEY:
        raise ValueError(f"give a key of {MIN_KEY} characters or more, or set {KEY_SETTING}")
    return key


def _hash(key: str, kind: str, step: Column, other: Column) -> Column:
    """48 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("long")


def _steps(back: bool) -> Column:
    return F.array(*(F.lit(k) for k in range(ROUNDS)[:: -1 if back else 1]))


def permute(value: Column, a: int | Column, b: int | Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of 0 .. a*b-1 (long), or its inverse."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))
    sign = -1 if back else 1

    def turn(s: Column, step: Column) -> Column:
        even = step % 2 == 0
        drawn = _hash(key, kind, step, F.when(even, s.y).otherwise(s.x))
        moved = lambda to, size: F.pmod(to + sign * F.pmod(drawn, size), size)
        return F.struct(F.when(even, moved(s.x, a)).otherwise(s.x).alias("x"), F.when(even, s.y).otherwise(moved(s.y, b)).alias("y"))

    start = F.struct(F.floor(value / b).cast("long").alias("x"), F.pmod(value, b).cast("long").alias("y"))
    return F.aggregate(_steps(back), start, turn, lambda s: s.x * b + s.y)


def _inside(value: Column, size: int, short: Column, a: int, b: int, key: str, kind: str, back: bool) -> Column:
    """permute, and where `short` holds, again until the result is below size.
    A walk leaves no more values than lie outside."""
    once = permute(value, a, b, key, kind, back)
    steps = F.sequence(F.lit(1), F.lit(a * b - size))
    walked = F.aggregate(steps, once, lambda x, _: F.when(x >= size, permute(x, a, b, key, kind, back)).otherwise(x))
    return F.when(short, walked).otherwise(once)


def _let(value: Column, body) -> Column:
    """body of value, evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _poured(shape: Column, digits: Column) -> Column:
    """The digits put in place of those of shape, one by one."""
    chars = F.filter(F.split(shape, ""), lambda x: x != "")
    starts = F.array(F.struct(F.lit("").alias("out"), F.lit(1).alias("at")))
    end = F.aggregate(
        chars,
        F.element_at(starts, 1),
        lambda acc, x: F.struct(F.concat(acc.out, F.when(x.rlike("^[0-9]$"), F.substring(digits, acc["at"], F.lit(1))).otherwise(x)).alias("out"), F.when(x.rlike("^[0-9]$"), acc["at"] + 1).otherwise(acc["at"]).alias("at")),
    )
    return end.out


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum modulo 10 of a string of digits."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10


def _padded(value: Column, width: Column) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0"))


def _card(c: Column, key: str, back: bool) -> Column:
    digits = _digits(c)
    n = F.length(digits)
    # all but the first and the check digit; the number of digits is part of what is hashed, through the sizes of the halves
    k = n - 2
    half = F.floor(k / 2)
    power = lambda e: F.round(F.pow(F.lit(10.0), e)).cast("long")
    turned = permute(F.substring(digits, F.lit(2), k).cast("long"), power(k - half), power(half), key, "card", back)
    mapped = F.lpad(turned.cast("string"), k.cast("int"), F.lit("0"))
    body = F.concat(F.substring(digits, 1, 1), mapped)
    whole = _let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0")))) % 10).cast("string")))
    return F.when((luhn_sum(digits) == 0) & n.between(13, 19), _poured(c, whole)).otherwise(c)


def _phone(c: Column, key: str, back: bool) -> Column:
    digits = _digits(c)
    ten = F.substring(digits, -10, 10)
    first = F.substring(ten, 1, 3).cast("long") - 200
    rest = F.substring(ten, 4, 7).cast("long") - 2_000_000
    turned = permute(first * 8_000_000 + rest, 800, 8_000_000, key, "phone", back)
    number = _let(turned, lambda t: F.concat((F.floor(t / 8_000_000) + 200).cast("string"), (t % 8_000_000 + 2_000_000).cast("string")))
    country = F.when(F.length(digits) == 11, F.lit("1")).otherwise(F.lit(""))
    return _poured(c, F.concat(country, number))


def _ssn(c: Column, key: str, back: bool) -> Column:
    digits = _digits(c)
    area, group, serial = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # 898 areas without 000, 666 and 900 up; 99 groups; 9999 serials
    index = (F.when(area > 666, area - 2).otherwise(area - 1)) * (99 * 9999) + (group - 1) * 9999 + serial - 1
    turned = permute(index, 898, 99 * 9999, key, "ssn", back)

    def spelled(t: Column) -> Column:
        place, inner = F.floor(t / (99 * 9999)), t % (99 * 9999)
        digits = ((F.when(place >= 665, place + 2).otherwise(place + 1), 3), (F.floor(inner / 9999) + 1, 2), (inner % 9999 + 1, 4))
        return F.concat(*(F.lpad(x.cast("string"), n, "0") for x, n in digits))

    number = _let(turned, spelled)
    return F.when(valid, _poured(c, number)).otherwise(c)


def _ipv4(c: Column, key: str, back: bool) -> Column:
    octets = F.transform(F.split(c, r"\."), lambda o: o.cast("long"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    turned = permute(value, 65536, 65536, key, "ipv4", back)
    spelled = _let(turned, lambda t: F.concat_ws(".", *((F.floor(t / 256**k) % 256).cast("string") for k in (3, 2, 1, 0))))
    return F.when(F.array_max(octets) <= 255, spelled).otherwise(c)


def _days(date: Column, key: str, kind: str, back: bool) -> Column:
    size = CYCLE[0] * CYCLE[1]
    first = F.lit(FIRST_DAY).cast("date")
    day = F.datediff(date, first).cast("long")
    cycle = F.floor(day / size)
    moved = _inside(F.pmod(day, F.lit(size)), LAST, cycle == FINAL, *CYCLE, key, kind, back)
    return F.date_add(first, (cycle * size + moved).cast("int"))


def _valid(date: Column) -> Column:
    return date.isNotNull() & (F.year(date) >= 1)


def _date(c: Column, key: str, back: bool) -> Column:
    date = F.try_to_date(c, "yyyy-MM-dd")
    return F.when(_valid(date), F.date_format(_days(date, key, "date", back), "yyyy-MM-dd")).otherwise(c)


def _day(c: Column, key: str, back: bool) -> Column:
    """Day, month, year, or month, day, year where only that is a date."""
    digits = _digits(c)
    forward, other = F.try_to_date(digits, "ddMMyyyy"), F.try_to_date(digits, "MMddyyyy")
    # a month-first date may turn into one that reads day-first, so each order keeps its own
    first = F.date_format(_days(forward, key, "day", back), "ddMMyyyy")
    return F.when(_valid(forward), _poured(c, first)).when(_valid(other), _poured(c, F.date_format(_late(other, key, back), "MMddyyyy"))).otherwise(c)


def _late(date: Column, key: str, back: bool) -> Column:
    """Month-first dates that can't be read day-first are those with a day from
    13 to the month's end; those of a 400-year cycle are permuted among
    themselves, all of them."""
    cycle = F.floor((F.year(date) - 1) / 400)
    origin = (cycle * 400 + 1).cast("int")
    zero = F.make_date(origin, F.lit(1), F.lit(1))
    # 12 days of this month and of each before it aren't counted
    index = F.datediff(date, zero).cast("long") - ((F.year(date) - origin) * 12 + F.month(date)) * 12

    def opens(m: Column) -> Column:
        return F.make_date((origin + F.floor(m / 12)).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))

    def new(t: Column) -> Column:
        # months have 18.4 such days on average, and the calendar strays from that by less than one month
        guess = F.floor(t * 4800 / (LATE[0] * LATE[1])).cast("long")
        m = F.array_max(F.filter(F.array(guess - 1, guess, guess + 1), lambda m: F.datediff(opens(m), zero) - m * 12 <= t))
        return _let(m, lambda m: F.date_add(zero, (t + (m + 1) * 12).cast("int")))

    return _let(_inside(index, LAST_LATE, cycle == FINAL, *LATE, key, "monthday", back), new)


def _email(c: Column, key: str, back: bool) -> Column:
    """The local part as two halves of characters; a round adds a keyed stream
    to each letter modulo 26 and each digit modulo 10 of one half."""
    local, domain = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")
    sign = -1 if back else 1

    def shifted(part: Column, other: Column, step: Column) -> Column:
        stream = F.concat(*(F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"email{k}"), step.cast("string"), F.length(local).cast("string"), other), 256) for k in range(2)))

        def one(i: Column) -> Column:
            x = F.substring(part, i, F.lit(1))
            code = F.ascii(x)
            add = sign * F.conv(F.substring(stream, i * 4 - 3, F.lit(4)), 16, 10).cast("int")
            turn = lambda low, n: F.char(F.pmod(code - low + add, F.lit(n)) + low)
            return F.when(code.between(48, 57), turn(48, 10)).when(code.between(65, 90), turn(65, 26)).when(code.between(97, 122), turn(97, 26)).otherwise(x)

        # at least one place, which is empty where the part is
        return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(part), F.lit(1))), one), "")

    def turn(s: Column, step: Column) -> Column:
        even = step % 2 == 0
        new = shifted(F.when(even, s.x).otherwise(s.y), F.when(even, s.y).otherwise(s.x), step)
        return F.struct(F.when(even, new).otherwise(s.x).alias("x"), F.when(even, s.y).otherwise(new).alias("y"))

    start = F.struct(F.substring(local, F.lit(1), half).alias("x"), F.substring(local, half + 1, F.length(local)).alias("y"))
    return F.aggregate(_steps(back), start, turn, lambda s: F.concat(s.x, s.y, F.lit("@"), domain))


_MAPS = {"email": _email, "ipv4": _ipv4, "date": _date, "day": _day, "ssn": _ssn, "phone": _phone, "card": _card}


def kind_of(match: Column) -> Column:
    """The first kind whose pattern is the whole match."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def pseudonym(match: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one matched value, or the value of a pseudonym."""
    out = match
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), _MAPS[kind](match, key, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str | None = None, text_col: str = "text", back: bool = False, found_col: str | None = None) -> DataFrame:
    """docs with the personal values of the text replaced; found_col adds the
    number of values that were replaced."""
    key, held = key_of(docs, key), fresh("done", docs)
    text = F.col(f"`{text_col}`")
    matches = F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)
    mapped = F.transform(matches, lambda m: pseudonym(m, key, back))

    def joined(new: Column) -> Column:
        # one gap more than matches
        parts = F.zip_with(F.split(text, ANY, -1), new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
        changed = F.zip_with(matches, new, lambda a, b: (a != b).cast("long"))
        return F.struct(F.array_join(parts, "").alias("text"), F.aggregate(changed, F.lit(0).cast("long"), lambda n, x: n + x).alias("n"))

    done = F.when(text.rlike(HINT) & text.rlike(ANY), _let(mapped, joined)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")))
    out = docs.withColumn(held, done).withColumn(text_col, F.col(f"{held}.text"))
    if found_col is not None:
        out = out.withColumn(found_col, F.col(f"{held}.n"))
    names = [*docs.columns, *([found_col] if found_col is not None and found_col not in docs.columns else [])]
    return out.select(*(F.col(f"`{c}`") for c in names))


def compiled() -> re.Pattern[str]:
    """The pattern for Python, for tests."""
    return re.compile(ANY)
