"""Format-preserving pseudonyms for private values, by a keyed Feistel network.

Values are found by one pattern and validated (check digits, ranges, calendar).
A value becomes a row of symbols, each with its own radix: digits, letters, the
four numbers of an address, year and day of a date. Even and odd places are the
two halves; each round adds to every symbol of one half, modulo its radix, a keyed
hash of the other half. That is a permutation of the values of one format, so equal
values stay equal, different ones different, and check digits are set anew.

All of it is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Symbols of the longest value whose halves are hashed as they are.
LONG = 1024
FIRST_DAY, YEARS, DAYS = "1900-01-01", 200, 365

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
#: The whole value, however long, keys in base64 and signed tokens included; a closing full stop is the sentence's.
SECRET = r"(?i:(?<![A-Za-z0-9])(?:password|passwd|token|secret|api[_-]?key))[\"']?\s{0,2}[=:]\s{0,2}[\"']?[0-9A-Za-z_./+=~-]{11,}[0-9A-Za-z_/+=~-]"
#: Countries by the length of their account numbers.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(countries: str, length: int) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: A number ends with its country's length; of countries not listed, with the last group.
IBAN = (
    r"\b(?:" + "|".join(_account(c, n) for n, c in IBAN_LENGTHS.items())
    + rf"|(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)\b"
)
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[./-]\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]\d)"
PHONE = (
    r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}|\+\d{8,15}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
)
CARD = r"(?<![\d.+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
#: In this order; the first that matches at a place counts.
PATTERNS = {
    "email": EMAIL,
    "access_key": ACCESS_KEY,
    "secret": SECRET,
    "iban": IBAN,
    "address": ADDRESS,
    "date": DATE,
    "social": SOCIAL,
    "phone": PHONE,
    "card": CARD,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Kinds whose values have to pass a test.
TESTED = ("iban", "address", "date", "social", "card")
#: What their patterns say of the text behind.
ENDS = {"iban": r"\b", "address": r"(?!\d|\.\d)", "date": r"(?!\d|[./-]\d)", "social": r"(?![\d-]\d)", "card": r"(?!\d)"}


def _characters(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1))


def _digits(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit(r"(\d)"), F.lit(1)), lambda c: c.cast("int"))


def _luhn(digits: Column) -> Column:
    """Sum by the Luhn rule; a multiple of ten for a valid number."""
    doubled = F.transform(
        F.reverse(digits), lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    )
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _mod97(value: Column) -> Column:
    """Remainder of an account number, its head moved to the end and letters read as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))

    def read(s: Column, c: Column) -> Column:
        at = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return (F.when(at < 10, s * 10).otherwise(s * 100) + at) % 97

    return F.aggregate(_characters(turned), F.lit(0), read)


def _days(value: Column) -> Column:
    """Days since the first one, null where the calendar has no such day."""
    day = F.coalesce(
        F.try_to_timestamp(F.when(value.rlike(r"^\d{4}-"), value), F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(F.when(value.contains("/"), value), F.lit("d/M/yyyy")),
        F.try_to_timestamp(F.when(value.contains("."), value), F.lit("d.M.yyyy")),
    )
    return F.datediff(day.cast("date"), F.lit(FIRST_DAY).cast("date"))


def _valid(value: Column, name: str) -> Column:
    """Whether a value of a tested kind passes; null counts as no."""
    if name == "iban":
        return _mod97(value) == 1
    if name == "address":
        return F.forall(F.split(value, r"\."), lambda x: F.try_to_number(x, F.lit("999")) < 256)
    if name == "date":
        return _days(value).between(0, YEARS * DAYS - 1)
    if name == "social":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return _luhn(_digits(value)) % 10 == 0


def _kind(value: Column) -> Column:
    """Kind of a found value: the first whose pattern and test it passes."""
    kind = None
    for name, p in PATTERNS.items():
        is_it = value.rlike(f"^(?:{p})$")
        is_it = is_it & _valid(value, name) if name in TESTED else is_it
        kind = F.when(is_it, F.lit(name)) if kind is None else kind.when(is_it, F.lit(name))
    return kind


def _candidates(source: Column) -> Column:
    """Whatever looks like a value of a tested kind, at every place, with its kind and whether it passes."""

    def of(name: str) -> Column:
        there = F.array_distinct(F.regexp_extract_all(source, F.lit(f"(?=({PATTERNS[name]}))"), F.lit(1)))
        return F.transform(
            there, lambda m: F.struct(m.alias("m"), F.lit(name).alias("k"), F.coalesce(_valid(m, name), F.lit(False)).alias("ok"))
        )

    return F.concat(*[of(name) for name in TESTED])


def _any_valid(candidates: Column) -> Column:
    """The pattern for a text: where a candidate fails, the values that pass stand in place of their kind's pattern.

    So what looks like a value and is none takes nothing from other values in or behind it.
    """

    def alternative(name: str) -> Column:
        if name not in TESTED:
            return F.lit(f"(?:{PATTERNS[name]})")
        passed = F.transform(F.filter(candidates, lambda c: (c["k"] == name) & c["ok"]), lambda c: F.concat(F.lit("\\Q"), c["m"], F.lit("\\E")))
        # the pattern itself still says what may stand around a value
        return F.when(
            F.size(passed) > 0, F.concat(F.lit(f"(?:(?={PATTERNS[name]})(?:"), F.array_join(F.reverse(F.array_sort(passed)), "|"), F.lit(f"){ENDS[name]})"))
        ).otherwise("(?!)")

    return F.when(F.forall(candidates, lambda c: c["ok"]), F.lit(ANY)).otherwise(
        F.concat_ws("|", *[alternative(name) for name in PATTERNS])
    )


def _item(text: Column, value: Column, radix: Column, alphabet: Column) -> Column:
    return F.struct(
        text.alias("c"), value.cast("int").alias("v"), radix.cast("int").alias("r"), alphabet.alias("a")
    )


def _alphabet(c: Column) -> Column:
    return (
        F.when(c.rlike("^[0-9]$"), DIGITS).when(c.rlike("^[a-z]$"), LOWER).when(c.rlike("^[A-Z]$"), UPPER).otherwise("")
    )


#: Numbers that each part of a social number may have: the first skips 000, 666 and 900 to 999, the others 0.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _area(number: Column) -> Column:
    return number - F.when(number > 666, 2).otherwise(1)


def _symbols(value: Column, kind: Column) -> Column:
    """The symbols of a value; radix 0 marks what stays, separators among it."""

    def lettered(first: Column, end: Column, alphabet=_alphabet) -> Column:
        def item(c: Column, i: Column) -> Column:
            a = F.when((i >= first) & (i < end), alphabet(c)).otherwise("")
            return _item(c, F.instr(a, c) - 1, F.length(a), a)

        return F.transform(_characters(value), item)

    def numbered(c: Column) -> Column:
        number = c.rlike("^[0-9]+$")
        return _item(c, F.when(number, c).otherwise(F.lit("-1")), F.when(number, 256).otherwise(0), F.lit(""))

    def hexed(c: Column) -> Column:
        return F.when(c.rlike("^[0-9a-f]$"), DIGITS + LOWER[:6]).otherwise(_alphabet(c))

    n = F.length(value)
    zero = F.lit(0)
    head = F.length(F.regexp_extract(value, r"""^([^=:]*[=:][\s"']*)""", 1))
    # past the country code
    dialled = F.length(F.regexp_extract(value, r"^(\+\d{1,3}(?=[ .(-])|\+\d)?", 1))
    days = _days(value)
    return (
        F.when(kind == "email", lettered(zero, F.instr(value, "@") - 1))
        .when(kind == "access_key", lettered(F.lit(4), n))
        .when((kind == "secret") & value.rlike("^[^=:]*[=:][\\s\"']*[0-9a-f]+$"), lettered(head, n, hexed))
        .when(kind == "secret", lettered(head, n))
        .when(kind == "iban", lettered(F.lit(4), n))
        .when(kind == "address", F.transform(F.regexp_extract_all(value, F.lit(r"(\d+|\.)"), F.lit(1)), numbered))
        .when(
            kind == "date",
            F.array(
                _item(F.lit(""), F.floor(days / DAYS), F.lit(YEARS), F.lit("")),
                _item(F.lit(""), days % DAYS, F.lit(DAYS), F.lit("")),
            ),
        )
        .when(
            kind == "social",
            F.array(
                _item(F.lit(""), _area(F.substring(value, 1, 3).cast("int")), F.lit(AREAS), F.lit("")),
                _item(F.lit(""), F.substring(value, 5, 2).cast("int") - 1, F.lit(GROUPS), F.lit("")),
                _item(F.lit(""), F.substring(value, 8, 4).cast("int") - 1, F.lit(SERIALS), F.lit("")),
            ),
        )
        .when(kind == "phone", lettered(dialled, n))
        # the first digit names the kind of card, the last is its check digit
        .when(kind == "card", lettered(F.lit(1), n - 1))
        .otherwise(lettered(zero, n))
    )


def _permuted(symbols: Column, kind: Column, key: str) -> Column:
    """The symbols that move, permuted; what stays has no part in it, so that spellings with other separators agree."""

    def one_round(state: Column, r: Column) -> Column:
        rest = F.concat_ws(",", F.transform(F.filter(state, lambda x, i: i % 2 != r % 2), lambda x: x["v"].cast("string")))

        # of a long half a digest, so that work grows with the length and not its square
        rest = F.when(F.size(state) > LONG, F.sha2(rest, 256)).otherwise(rest)

        def moved(x: Column, i: Column, rest: Column) -> Column:
            said = F.concat_ws("|", F.lit(key), kind, F.size(state).cast("string"), r.cast("string"), i.cast("string"), rest)
            drawn = F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("long")
            turns = (x["r"] > 0) & (i % 2 == r % 2)
            value = F.when(turns, (x["v"] + drawn % F.greatest(x["r"], F.lit(1))) % F.greatest(x["r"], F.lit(1))).otherwise(x["v"])
            return _item(x["c"], value, x["r"], x["a"])

        # through an array of one, or the half would be read again for each symbol
        return F.element_at(F.transform(F.array(rest), lambda half: F.transform(state, lambda x, i: moved(x, i, half))), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.filter(symbols, lambda x: x["r"] > 0), one_round)


def _put_back(symbols: Column, moved: Column) -> Column:
    """The value with its moved symbols in their places, between those that stay."""

    def next_one(done: Column, x: Column) -> Column:
        m = F.try_element_at(moved, done["at"])
        shown = F.when(m["a"] == "", m["v"].cast("string")).otherwise(F.substr(m["a"], m["v"] + 1, F.lit(1)))
        text = F.concat(done["text"], F.when(x["r"] == 0, x["c"]).otherwise(shown))
        return F.struct(text.alias("text"), (done["at"] + F.when(x["r"] == 0, 0).otherwise(1)).alias("at"))

    # a place beyond the last moved symbol is never read, but asked for
    return F.aggregate(symbols, F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), next_one)["text"]


def _written(value: Column, kind: Column, stays: Column, symbols: Column) -> Column:
    # where nothing stays the symbols are simply lined up
    lined = F.array_join(
        F.transform(symbols, lambda x: F.when(x["a"] == "", x["v"].cast("string")).otherwise(F.substr(x["a"], x["v"] + 1, F.lit(1)))), ""
    )
    plain = F.when(F.size(stays) == F.size(symbols), lined).otherwise(_put_back(stays, symbols))
    part = lambda i, size: F.lpad((F.try_element_at(symbols, F.lit(i))["v"] + 1).cast("string"), size, "0")
    area = F.try_element_at(symbols, F.lit(1))["v"]
    social = F.concat_ws("-", F.lpad((area + F.when(area >= 665, 2).otherwise(1)).cast("string"), 3, "0"), part(2, 2), part(3, 4))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), F.try_element_at(symbols, F.lit(1))["v"] * DAYS + F.try_element_at(symbols, F.lit(2))["v"])
    pattern = (
        F.when(value.rlike(r"^\d{4}-"), "yyyy-MM-dd")
        .when(value.rlike(r"^\d\d/\d\d/"), "dd/MM/yyyy")
        .when(value.contains("/"), "d/M/yyyy")
        .when(value.rlike(r"^\d\d\.\d\d\."), "dd.MM.yyyy")
        .otherwise("d.M.yyyy")
    )
    body = F.substr(plain, F.lit(1), F.length(plain) - 1)
    check = (10 - _luhn(_digits(F.concat(body, F.lit("0")))) % 10) % 10
    cleared = F.concat(F.substring(plain, 1, 2), F.lit("00"), F.substring(plain, 5, 100))
    return (
        F.when(kind == "date", _dated(day, pattern))
        .when(kind == "social", social)
        .when(kind == "card", F.concat(body, check.cast("string")))
        .when(
            kind == "iban",
            F.concat(
                F.substring(plain, 1, 2), F.lpad((98 - _mod97(cleared)).cast("string"), 2, "0"), F.substring(plain, 5, 100)
            ),
        )
        .otherwise(plain)
    )


def _dated(day: Column, pattern: Column) -> Column:
    written = None
    for p in ("yyyy-MM-dd", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yyyy"):
        as_is = F.date_format(day, p)
        written = F.when(pattern == p, as_is) if written is None else written.when(pattern == p, as_is)
    return written.otherwise(F.date_format(day, "d.M.yyyy"))


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with `text` replaced and two columns more: n_private and private_kinds.

    Every valid value is replaced by its pseudonym under `key`; all else stays, byte
    for byte, so a text without such values is unchanged. n_private counts values,
    private_kinds is an array of their kinds, sorted. The e-mail's domain, the country
    code, the card's first digit and the name before a secret stay, and so do separators:
    one card, account or phone number has one pseudonym however it is spelled. Social
    numbers become valid ones.

    A null text stays null with no values found, an empty one empty. Other columns
    pass through; one called n_private or private_kinds gives way to the new one.
    Repeated rows are treated alike; an empty table gives an empty result.
    """
    # the caller's columns are one, so that those below cannot clash with them
    docs_in = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    source = F.col("_text")
    hit = source.rlike(ANY)
    # a column of its own: it is read many times and found once
    docs_in = docs_in.withColumn("_candidates", F.when(hit, _candidates(source)))
    docs_in = docs_in.withColumn("_any", F.when(F.col("_candidates").isNotNull(), _any_valid(F.col("_candidates"))))
    found = F.transform(
        F.regexp_extract_all(source, F.col("_any"), F.lit(0)), lambda m: F.struct(m.alias("m"), _kind(m).alias("k"))
    )
    split = F.transform(found, lambda x: F.struct(x["m"], x["k"], F.when(x["k"].isNotNull(), _symbols(x["m"], x["k"])).alias("s")))
    turned = F.transform(
        split, lambda x: F.struct(x["m"], x["k"], x["s"], F.when(x["k"].isNotNull(), _permuted(x["s"], x["k"], key)).alias("p"))
    )
    new = F.transform(
        turned,
        lambda x: F.struct(x["k"].alias("k"), F.when(x["k"].isNull(), x["m"]).otherwise(_written(x["m"], x["k"], x["s"], x["p"])).alias("w")),
    )
    values = F.when(F.col("_any").isNotNull(), new)
    between = F.split(source, F.col("_any"), -1)
    joined = F.concat(
        F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size("_values")), F.col("_values"), lambda b, x: F.concat(b, x["w"])), ""),
        F.element_at(between, -1),
    )
    kinds = F.filter(F.transform("_values", lambda x: x["k"]), lambda k: k.isNotNull())
    n = F.coalesce(F.greatest(F.size(F.when(F.col("_values").isNotNull(), kinds)), F.lit(0)), F.lit(0))
    new = F.when(F.col("_values").isNotNull(), joined).otherwise(source)
    given = [c for c in docs.columns if c not in ("n_private", "private_kinds")]
    return docs_in.withColumn("_values", values).select(
        *[(new if c == text else F.col(f"_row.`{c}`")).alias(c) for c in given],
        n.cast("long").alias("n_private"),
        F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("private_kinds"),
    )
