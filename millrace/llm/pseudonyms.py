"""Personal data replaced by keyed pseudonyms of the same format, in DataFrame functions only.

Numbers that pass their own check (cards, bank accounts, social security numbers,
addresses of hosts, phone numbers) and dates are permuted within their format by a
keyed Feistel network: an equal value gets an equal pseudonym in every document, and
two values never share one. E-mail addresses and secrets, which are no numbers, get
keyed digests in their own alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import unused

#: Rounds of two half rounds each.
ROUNDS = 4
#: Of tests and of the query; a real key is the caller's secret.
DEMO_KEY = "millrace demonstration key"

#: Candidates by kind, in order of precedence. Lookbehinds keep a run of characters from
#: being tried from each of its places.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{10,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])"
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
KINDS = ("email", "secret", "iban", "phone", "date", "ssn", "card", "ipv4")
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IBAN, PHONE, DATE, SSN, CARD, IPV4))

#: The first day of the dates that are permuted, and their number: one cycle of the calendar, 189 x 773 days.
FIRST_DAY = "1800-01-01"
CYCLE = (189, 773)


def _number(digits: Column) -> Column:
    """A digit string of at most 18 digits as a long; empty is 0."""
    return F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).cast("long")


def _hash(key: Column, kind: Column, turn: Column, half: Column, modulus: Column) -> Column:
    """The round function: 60 bits of a keyed SHA-256, below ``modulus``."""
    mixed = F.sha2(F.concat_ws("|", key, kind, turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(mixed, 1, 15), 16, 10).cast("long") % modulus


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, kind: Column, rounds: int = ROUNDS) -> Column:
    """struct(l, r): a permutation of the pairs of 0..a-1 and 0..b-1."""
    def turn(state: Column, i: Column) -> Column:
        new_left = (state["l"] + _hash(key, kind, 2 * i, state["r"], a)) % a
        return F.struct(new_left.alias("l"), ((state["r"] + _hash(key, kind, 2 * i + 1, new_left, b)) % b).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _luhn(digits: Column, odd_doubled: bool) -> Column:
    """Sum of the digits, each second one from the right doubled (the first too, if ``odd_doubled``)."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = (i % 2 == (1 if odd_doubled else 0))
        return total + F.when(twice & (digit > 4), 2 * digit - 9).when(twice, 2 * digit).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refill(like: Column, digits: Column) -> Column:
    """``like`` with its digits replaced, in order, by ``digits``."""
    def step(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(state["out"], F.when(is_digit, F.substring(digits, state["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (state["k"] + is_digit.cast("int")).alias("k"))

    return F.aggregate(F.split(like, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step)["out"]


def _halves(digits: Column, key: Column, kind: str) -> Column:
    """Any digits, permuted among those of their length (up to 36)."""
    n = F.length(digits)
    k = (n / 2).cast("int")
    power = lambda m: F.concat(F.lit("1"), F.repeat(F.lit("0"), m)).cast("long")
    new = feistel(_number(F.substring(digits, F.lit(1), k)), _number(F.substring(digits, k + 1, n - k)), power(k), power(n - k), key, F.concat(F.lit(kind), n.cast("string")))
    both = F.transform(F.array(new), lambda s: F.concat(F.lpad(s["l"].cast("string"), k, F.lit("0")), F.lpad(s["r"].cast("string"), n - k, F.lit("0"))))
    return both[0]


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _card(m: Column, key: Column) -> Column:
    """The first digit stays, the check digit is made anew; numbers that fail the check stay."""
    def permuted(d: Column) -> Column:
        n = F.length(d)
        new = _let(F.concat(F.substring(d, 1, 1), _halves(F.substring(d, F.lit(2), n - 2), key, "card")), lambda p: F.concat(p, ((10 - _luhn(p, True) % 10) % 10).cast("string")))
        return F.when(_luhn(d, False) % 10 == 0, _refill(m, new)).otherwise(m)

    return _let(F.regexp_replace(m, "[^0-9]", ""), permuted)


def _phone(m: Column, key: Column) -> Column:
    def permuted(d: Column) -> Column:
        n = F.length(d)
        return _refill(m, F.concat(F.substring(d, F.lit(1), n - 10), _halves(F.substring(d, n - 9, F.lit(10)), key, "phone")))

    return _let(F.regexp_replace(m, "[^0-9]", ""), permuted)


def _ssn(m: Column, key: Column) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
    new = feistel(index, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

    def shown(s: Column) -> Column:
        k = (s["l"] / 99).cast("int")
        pad = lambda x, w: F.lpad(x.cast("string"), w, "0")
        return F.concat_ws("-", pad(k + 1 + (k >= 665).cast("int"), 3), pad(s["l"] % 99 + 1, 2), pad(s["r"] + 1, 4))

    return F.when(valid, _let(new, shown)).otherwise(m)


def _iban(m: Column, key: Column) -> Column:
    """The account's digits are permuted; country, letters and spaces stay, the check digits are made anew."""
    def rest(account: Column, country: Column, check: Column) -> Column:
        def add(total: Column, c: Column) -> Column:
            return F.when(c.between("0", "9"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 55) % 97

        return F.aggregate(F.split(F.concat(account, country, check), ""), F.lit(0), lambda total, c: F.when(c == "", total).otherwise(add(total, c)))

    def permuted(whole: Column) -> Column:
        country, check, account = F.substring(whole, 1, 2), F.substring(whole, 3, 2), F.substring(whole, F.lit(5), F.length(whole) - 4)
        digits = F.regexp_replace(account, "[^0-9]", "")
        fresh = _let(_halves(digits, key, "iban"), lambda x: F.concat(F.lpad((98 - rest(_refill(account, x), country, F.lit("00"))).cast("string"), 2, "0"), x))
        return F.when((F.length(digits) > 1) & (rest(account, country, check) == 1), _refill(m, fresh)).otherwise(m)

    return _let(F.replace(m, F.lit(" "), F.lit("")), permuted)


def _ipv4(m: Column, key: Column) -> Column:
    parts = F.split(m, r"\.")
    octets = [F.get(parts, F.lit(i)).cast("int") for i in range(4)]
    valid = octets[0].between(0, 255)
    for i, o in enumerate(octets):
        valid = valid & (o <= 255) & (F.length(F.get(parts, F.lit(i))) == F.length(o.cast("string")))
    side = F.lit(1 << 16)
    new = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], side, side, key, F.lit("ipv4"))
    byte = lambda x, shift: F.shiftright(x, shift).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return F.when(valid, _let(new, lambda s: F.concat_ws(".", byte(s["l"], 8), byte(s["l"], 0), byte(s["r"], 8), byte(s["r"], 0)))).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    """yyyy-mm-dd, mm/dd/yyyy and dd.mm.yyyy, where the calendar has the day and its year is 1800 to 2199."""
    iso = F.when(F.substring(m, 5, 1) == "-", m).when(F.substring(m, 3, 1) == "/", F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    first = F.lit(FIRST_DAY).cast("date")
    a, b = CYCLE

    def permuted(day: Column) -> Column:
        k = F.datediff(day, first)
        new = _let(feistel((k / b).cast("int"), k % b, F.lit(a), F.lit(b), key, F.lit("date")), lambda s: F.date_add(first, (s["l"] * b + s["r"]).cast("int")))
        shown = _let(new, lambda d: F.when(F.substring(m, 5, 1) == "-", F.date_format(d, "yyyy-MM-dd")).when(F.substring(m, 3, 1) == "/", F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy")))
        return F.when((k >= 0) & (k < a * b), shown).otherwise(m)

    return F.coalesce(_let(iso.try_cast("date"), permuted), m)


def _digest(m: Column, key: Column, kind: str) -> Column:
    return F.sha2(F.concat_ws("|", key, F.lit(kind), F.lower(m)), 256)


def _email(m: Column, key: Column) -> Column:
    """A local part of 20 hexadecimal digits at a reserved domain."""
    return F.concat(F.substring(_digest(m, key, "email"), 1, 20), F.lit("@example.org"))


def _secret(m: Column, key: Column) -> Column:
    made = F.substring(_digest(m, key, "secret"), F.lit(1), F.length(m))
    return F.when((F.upper(m) == m) & (F.lower(m) != m), F.upper(made)).otherwise(made)


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of one candidate, or itself if it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), _email(m, key))
        .when(whole("[0-9A-Fa-f]{32,64}"), _secret(m, key))
        .when(whole("[A-Z]{2}[0-9]{2}[0-9A-Z ]+"), _iban(m, key))
        .when(whole(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}"), _date(m, key))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), _ssn(m, key))
        .when(whole(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), _ipv4(m, key))
        .when(whole(r"(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"), _card(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the text's personal data replaced, and n_values: how many values were.

    A null text stays null with 0 values, other texts keep all else as it was;
    rows are independent of each other. Candidates that fail their check (a card
    number's check digit, a day the calendar lacks) stay as they are. A column
    n_values of the input is replaced, others of any name are kept; texts of any
    length are searched whole, repeated rows are each returned, and an empty table
    gives no rows.
    """
    text, secret = F.col(f"`{text_col}`"), F.lit(key)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    # most texts have no candidate: the rest is worked out for the others only
    old, new = unused(docs.columns, "_mr_found", "_mr_new")
    marked = docs.withColumn(old, F.when(text.rlike("[0-9@]") & text.rlike(PATTERN), found))
    marked = marked.withColumn(new, F.transform(old, lambda m: pseudonym(m, secret)))
    pieces = F.transform(F.split(text, PATTERN, -1), lambda piece, i: F.concat(piece, F.coalesce(F.get(F.col(new), i), F.lit(""))))
    changed = F.aggregate(F.zip_with(old, new, lambda x, y: (x != y).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return marked.withColumn("n_values", F.coalesce(changed, F.lit(0).cast("long"))).withColumn(text_col, F.when(F.col(old).isNotNull(), F.array_join(pieces, "")).otherwise(text)).drop(old, new)
