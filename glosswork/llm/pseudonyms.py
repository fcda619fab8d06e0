"""Format-preserving pseudonyms, in DataFrame functions only.

Card numbers, social security numbers, phone numbers, IPv4 addresses and dates that
pass validation, and mail addresses, are replaced by values of the same form. Each
kind's values are numbered, and a keyed Feistel network permutes the numbers, so equal
values get equal pseudonyms in every document, different ones different ones, and
whoever has the key can turn them back. Nothing is shuffled or looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import let, starts_of

ROUNDS = 10
# Dates are permuted among 270 * 270 days, nearly 200 years, from this day on.
FIRST_DAY, DAYS_ROOT = "1900-01-01", 270

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
_PHONE = r"(?<![0-9A-Za-z+(])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
_DATE = (r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})"
         r"(?![0-9A-Za-z/-]|\.[0-9])")
_IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
_SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
_CARD = r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])"
# Groupings that cards are printed in; they may stand beside other numbers. The second
# has a longer card at places where the first has one.
_PRINTED = tuple(
    r"(?<![0-9A-Za-z.-])(?=(" + form + r")(?![0-9A-Za-z]))" for form in (
        r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{4,5}",
        r"[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}\2[0-9]{3}"))
_OTHERS = "|".join((_EMAIL, _DATE, _SSN, _PHONE, _IPV4))
PATTERN = f"{_OTHERS}|{_CARD}"
KINDS = ("email", "date", "ssn", "phone", "ipv4", "card")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _number(key: str, *message: Column) -> Column:
    """56 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), *message)
    digest = F.sha2(F.concat(F.lit(key), F.sha2(text.cast("binary"), 256)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")


def feistel(value: Column, a: Column, b: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of 0 .. a*b-1. The two parts, of a and of b values, change in
    turn, each by a hash of the other."""
    start = let(value, lambda x: F.struct(((x - F.pmod(x, b)) / b).cast("bigint").alias("u"), F.pmod(x, b).alias("v")))
    sign = -1 if back else 1

    def turn(s: Column, r: Column) -> Column:
        left = r % 2 == 0
        shift = F.lit(sign) * F.pmod(_number(key, tweak, r.cast("string"), F.when(left, s["v"]).otherwise(s["u"]).cast("string")),
                                     F.when(left, a).otherwise(b))
        return F.struct(F.when(left, F.pmod(s["u"] + shift, a)).otherwise(s["u"]).alias("u"),
                        F.when(left, s["v"]).otherwise(F.pmod(s["v"] + shift, b)).alias("v"))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*map(F.lit, order)), start, turn, lambda s: s["u"] * b + s["v"])


def _long(digits: Column) -> Column:
    return digits.cast("bigint")


def _power(n: Column) -> Column:
    return _long(F.rpad(F.lit("1"), n + 1, "0"))


def _padded(number: Column, width) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _luhn(digits: Column) -> Column:
    """The Luhn sum, from the right, the last digit counted once."""
    def term(text: Column, i: Column) -> Column:
        d = F.substring(text, F.length(text) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return let(digits, lambda text: F.aggregate(
        F.sequence(F.lit(0), F.length(text) - 1), F.lit(0), lambda s, i: s + term(text, i)))


def _card(digits: Column, key: str, back: bool) -> Column:
    """The issuer's digit stays, the digits up to the check digit are permuted, and the
    check digit follows from them."""
    middle = F.length(digits) - 2
    half = F.floor(middle / 2).cast("int")
    body = F.concat(F.substring(digits, 1, 1), _padded(feistel(
        _long(F.substring(digits, F.lit(2), middle)), _power(half), _power(middle - half), key,
        F.concat(F.lit("card"), F.substring(digits, 1, 1), middle.cast("string")), back), middle))
    return let(body, lambda d: F.concat(d, F.pmod(10 - _luhn(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))


def _phone(digits: Column, key: str, back: bool) -> Column:
    """The last ten digits. The numbering plan has no area or exchange below 200; each
    stays on its side of that, so valid numbers stay valid."""
    d = F.right(digits, F.lit(10))
    area, exchange, line = (_long(F.substring(d, *x)) for x in ((1, 3), (4, 3), (7, 4)))
    low = lambda x: F.when(x >= 200, 200).otherwise(0).cast("bigint")
    size = lambda x: F.when(x >= 200, 800).otherwise(200).cast("bigint")
    exchanges = size(exchange)
    index = ((area - low(area)) * exchanges + exchange - low(exchange)) * 10_000 + line
    new = feistel(index, (size(area) * exchanges / 100).cast("bigint"), F.lit(1_000_000).cast("bigint"), key,
                  F.concat_ws(" ", F.lit("phone"), low(area).cast("string"), low(exchange).cast("string")), back)

    def written(number: Column) -> Column:
        end = F.pmod(number, F.lit(10_000))
        rest = ((number - end) / 10_000).cast("bigint")
        near = F.pmod(rest, exchanges)
        return F.concat(
            F.substring(digits, F.lit(1), F.length(digits) - 10),
            _padded(((rest - near) / exchanges).cast("bigint") + low(area), 3), _padded(near + low(exchange), 3), _padded(end, 4))

    return let(new, written)


def _ssn(digits: Column, key: str, back: bool) -> Column:
    """Areas 001 to 899 but 666, no zero group or serial."""
    area, group, serial = (_long(F.substring(digits, *x)) for x in ((1, 3), (4, 2), (6, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    index = (place * 99 + group - 1) * 9_999 + serial - 1
    new = feistel(index, F.lit(898 * 99).cast("bigint"), F.lit(9_999).cast("bigint"), key, F.lit("ssn"), back)

    def written(number: Column) -> Column:
        low = F.pmod(number, F.lit(9_999))
        rest = ((number - low) / 9_999).cast("bigint")
        middle = F.pmod(rest, F.lit(99))
        top = ((rest - middle) / 99).cast("bigint")
        return F.concat(_padded(top + F.when(top >= 665, 2).otherwise(1), 3), _padded(middle + 1, 2), _padded(low + 1, 4))

    return let(new, written)


def _ipv4(value: Column, key: str, back: bool) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("bigint"), lambda s, o: s * 256 + _long(o))
    side = F.lit(65_536).cast("bigint")
    new = feistel(number, side, side, key, F.lit("ipv4"), back)
    octet = lambda n, k: F.call_function("shiftright", n, k).bitwiseAND(255).cast("string")
    return let(new, lambda n: F.concat_ws(".", *[octet(n, F.lit(k)) for k in (24, 16, 8, 0)]))


_FORMS = (("-", "yyyy-MM-dd"), (".", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"))


def _day(value: Column) -> Column:
    """The date, or null where it is none. Slashes are read month first."""
    d = F.lit(None).cast("date")
    for mark, form in _FORMS:
        d = F.when(F.contains(value, F.lit(mark)), F.to_date(F.try_to_timestamp(value, F.lit(form)))).otherwise(d)
    return d


def _date(value: Column, key: str, back: bool) -> Column:
    """Permuted within its window of DAYS_ROOT squared days."""
    size = F.lit(DAYS_ROOT**2).cast("bigint")
    side = F.lit(DAYS_ROOT).cast("bigint")

    def moved(days: Column) -> Column:
        window = F.floor(days / size)
        new = feistel(F.pmod(days, size), side, side, key, F.concat(F.lit("date"), window.cast("string")), back)
        return F.date_add(F.lit(FIRST_DAY).cast("date"), (new + window * size).cast("int"))

    def written(day: Column) -> Column:
        out = F.lit(None).cast("string")
        for mark, form in _FORMS:
            out = F.when(F.contains(value, F.lit(mark)), F.date_format(day, form)).otherwise(out)
        return out

    return let(let(F.datediff(_day(value), F.lit(FIRST_DAY).cast("date")).cast("bigint"), moved), written)


def _shifted(text: Column, hashed: Column, sign: int) -> Column:
    """Letters and digits moved on within their class by the bytes of a hash."""
    def moved(text: Column, hashed: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        by = F.lit(sign) * F.conv(F.substring(hashed, 1 + 2 * F.pmod(i, F.lit(32)), F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        within = lambda first, n: F.char(first + F.pmod(code - first + by, F.lit(n)))
        return (F.when(c.between("a", "z"), within(97, 26)).when(c.between("A", "Z"), within(65, 26))
                .when(c.between("0", "9"), within(48, 10)).otherwise(c))
    return F.when(F.length(text) == 0, text).otherwise(let(text, lambda t: let(hashed, lambda h: F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: moved(t, h, i)), ""))))


def _email(value: Column, key: str, back: bool) -> Column:
    """The local part, in two halves that change in turn; the domain stays."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    half = F.floor(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("u"), F.substring(local, half + 1, F.length(local)).alias("v"))
    sign = -1 if back else 1

    def turn(s: Column, r: Column) -> Column:
        left = r % 2 == 0
        text = F.concat_ws("|", F.lit(key), F.lit("email"), domain, r.cast("string"), F.when(left, s["v"]).otherwise(s["u"]))
        hashed = F.sha2(F.concat(F.lit(key), F.sha2(text.cast("binary"), 256)).cast("binary"), 256)
        moved = _shifted(F.when(left, s["u"]).otherwise(s["v"]), hashed, sign)
        return F.struct(F.when(left, moved).otherwise(s["u"]).alias("u"), F.when(left, s["v"]).otherwise(moved).alias("v"))

    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.concat(F.aggregate(F.array(*map(F.lit, order)), start, turn, lambda s: F.concat(s["u"], s["v"])), F.lit("@"), domain)


def _formed(value: Column, digits: Column) -> Column:
    """``digits`` in the places of the value's digits."""
    def char(new: Column, c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), F.lit("[^0-9]"), F.lit("")))
        return F.when(c.between("0", "9"), F.substring(new, place, F.lit(1))).otherwise(c)
    return let(digits, lambda new: F.array_join(F.transform(F.split(value, ""), lambda c, i: char(new, c, i)), ""))


def _valid_card(value: Column) -> Column:
    return _luhn(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0


def pattern_of(text: Column) -> Column:
    """PATTERN with the text's own valid cards in place of all that looks like one, so an
    invalid or longer run of numbers does not take its neighbours along. Printed
    groupings go before a longest run that contains them."""
    first, second = (F.filter(F.regexp_extract_all(text, F.lit(form), F.lit(1)), _valid_card) for form in _PRINTED)
    runs = F.filter(F.regexp_extract_all(text, F.lit(_CARD), F.lit(0)), _valid_card)

    def joined(printed: Column) -> Column:
        others = F.filter(runs, lambda r: ~F.exists(printed, lambda c: F.contains(r, c)))
        return let(F.array_distinct(F.concat(printed, others)), lambda cards: F.when(F.size(cards) == 0, _OTHERS).otherwise(
            F.concat(F.lit(_OTHERS + r"|(?<![0-9A-Za-z.-])(?:"), F.array_join(cards, "|"), F.lit(r")(?![0-9A-Za-z])"))))

    return let(F.concat(first, second), joined)


def kind_of(value: Column) -> Column:
    """The kind of a match, or null where it fails validation."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(value.rlike(f"^(?:{_DATE})$"), F.when(_day(value).isNotNull(), "date"))
        .when(value.rlike(f"^(?:{_SSN})$"), F.when(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "ssn"))
        .when(value.rlike(f"^(?:{_PHONE})$"), "phone")
        .when(value.rlike(f"^(?:{_IPV4})$"), F.when(~F.exists(F.split(value, r"\."), lambda o: (o.cast("int") > 255) | o.rlike("^0[0-9]")), "ipv4"))
        .when(value.rlike(f"^(?:{_CARD})$"), F.when(_luhn(digits) % 10 == 0, "card"))
    )


def pseudonym(value: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The value's pseudonym, or with ``back`` the value of a pseudonym; other values
    stay as they are."""
    def with_digits(new) -> Column:
        return let(F.regexp_replace(value, "[^0-9]", ""), lambda digits: _formed(value, new(digits, key, back)))

    return (
        F.when(kind == "email", _email(value, key, back)).when(kind == "date", _date(value, key, back))
        .when(kind == "ssn", with_digits(_ssn)).when(kind == "phone", with_digits(_phone))
        .when(kind == "ipv4", _ipv4(value, key, back)).when(kind == "card", with_digits(_card))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii", back: bool = False,
                 only_found: bool = False) -> DataFrame:
    """``docs`` with the values in ``text_col`` replaced and, in ``found_col`` (replaced
    where it exists), ``kind, start, end, pseudonym`` of each, by place in the original
    text (code points).

    Null texts stay null and have no values; invalid numbers and dates stay as they
    are. ``back`` undoes it, with the same key; only a valid run of numbers in no printed
    grouping of cards may by chance hold or touch a valid one afterwards and be misread. ``only_found`` leaves out rows without
    any value; most texts have none, and one look for the pattern settles that.
    """
    text = F.col(f"`{text_col}`")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, found_col)]
    names = [c for c in docs.columns if c != found_col]
    pattern = F.lit(PATTERN)
    none = F.array().cast("array<string>")
    hit = F.rlike(F.coalesce(text, F.lit("")), pattern)
    if only_found:
        docs = docs.where(hit)
    # The text's own pattern, written out once a row.
    found = F.when(hit, let(pattern_of(text), lambda own: F.struct(
        F.split(text, own, -1).alias("pieces"), F.regexp_extract_all(text, own, F.lit(0)).alias("values"))))
    parts = docs.select(*others, text.alias(text_col), hit.alias("_hit"), found.alias("_found")).select(
        *others, text.alias(text_col), "_hit",
        F.coalesce("_found.pieces", none).alias("_pieces"), F.coalesce("_found.values", none).alias("_values"))
    # Kind first, then pseudonym: each is computed once a value.
    parts = parts.withColumn("_values", F.transform("_values", lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind"))))
    if only_found:
        parts = parts.where(F.exists("_values", lambda v: v["kind"].isNotNull()))
    parts = parts.withColumn("_values", F.transform("_values", lambda v: F.struct(
        v["value"].alias("value"), v["kind"].alias("kind"), pseudonym(v["value"], v["kind"], key, back).alias("new"))))
    steps = F.arrays_zip(F.slice("_pieces", 1, F.size("_values")).alias("piece"), F.col("_values").alias("v"))
    spans = let(steps, lambda known: F.filter(
        F.zip_with(
            known, starts_of(F.transform(known, lambda x: F.length(x["piece"]) + F.length(x["v"]["value"]))),
            lambda x, at: F.when(x["v"]["kind"].isNotNull(), F.struct(
                x["v"]["kind"].alias("kind"), (at + F.length(x["piece"])).alias("start"),
                (at + F.length(x["piece"]) + F.length(x["v"]["value"])).alias("end"), x["v"]["new"].alias("pseudonym")))),
        lambda s: s.isNotNull()))
    woven = F.array_join(F.zip_with("_pieces", F.transform("_values", lambda v: v["new"]),
                                    lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    return parts.select(*[
        (F.when(F.col("_hit"), woven).otherwise(text).alias(text_col) if c == text_col else F.col(f"`{c}`")) for c in names
    ], spans.alias(found_col))
