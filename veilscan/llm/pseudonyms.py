"""Format-preserving pseudonyms for personal numbers, dates and addresses, in SQL functions alone.

A value is found by one pattern, validated (calendar, checksum, ranges), and replaced by the image
under a keyed permutation of all values of its format: a Feistel network over the two halves of its
digits whose round function is a keyed SHA-256.  Formats with fewer values than digit strings (dates,
social security numbers) repeat the permutation until it gives a valid value, which is again a
permutation.  So equal values get equal pseudonyms in every document, different values different
ones, and the result still passes the validation; separators stay.

Kinds: ``email`` (the part before ``@``), ``iban`` (with its check digits and its country's length;
the country stays), ``ip`` (IPv4), ``date`` (ISO, and day and month first), ``ssn``, ``phone`` (the
number after the country code), ``card`` (Luhn; first digit and scheme stay).

Phone numbers are a ``+`` with 7 to 15 digits and single separators anywhere, or national numbers in
groups: 3-3-4 digits, or 9 to 12 digits that start with 0.  After a ``+`` (but not ``+1``, whose numbers
have ten digits) nothing says where a number ends, so digits after one space belong to it up to 15.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: How often a value is permuted again at most; missing a valid one is less likely than 1e-12.
WALKS = 24

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_EDGE, _END = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Countries by the length of their IBANs.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK",
    21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL",
    24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA",
    30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _iban_pattern(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    last = rf" [A-Z0-9]{{{rest}}}" if rest else ""
    return (rf"(?:{countries})[0-9]{{2}}(?:[A-Z0-9]{{{size - 4}}}"
            rf"|(?: [A-Z0-9]{{4}}){{{groups}}}{last})")


#: What may lie between two digits of a phone number; a number does not end within a dotted or
#: dashed value.
_GAP = r"(?: ?\(|\)[ .\-/]?|[ .\-/])?"
_PHONE_END = rf"{_END}(?![.\-/][0-9])"
#: Country codes of telephone numbers; all others have three digits.
COUNTRY_CODE = (r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})")
#: Patterns by kind, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@"
             r"(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "iban": rf"{_EDGE}(?:{'|'.join(_iban_pattern(n, c) for n, c in IBAN_COUNTRIES.items())}){_END}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": rf"{_EDGE}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}"
            rf"|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}){_END}",
    "ssn": rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}",
    "phone": rf"(?<![0-9A-Za-z+])\+(?:1(?:{_GAP}[0-9]){{10}}|[0-9](?:{_GAP}[0-9]){{6,14}}){_PHONE_END}"
             rf"|(?<![0-9A-Za-z+])\([0-9]{{3}}\) ?[0-9]{{3}}[ .\-][0-9]{{4}}{_END}"
             rf"|(?<![0-9A-Za-z+])\(0[1-9][0-9]{{0,4}}\) ?[0-9](?:[ .\-/]?[0-9]){{4,8}}{_PHONE_END}"
             rf"|{_EDGE}[0-9]{{3}}[.\-][0-9]{{3}}[.\-][0-9]{{4}}{_END}"
             rf"|{_EDGE}[2-9][0-9]{{2}} [2-9][0-9]{{2}}[ .\-][0-9]{{4}}{_PHONE_END}"
             rf"|{_EDGE}(?=0[1-9][0-9]{{0,4}}[ .\-/])0[1-9](?:[ .\-/]?[0-9]){{7,10}}{_PHONE_END}",
    "card": rf"{_EDGE}(?:[0-9]{{13,19}}|[0-9]{{4}}(?: [0-9]{{4}}){{2}} [0-9]{{1,7}}"
            rf"|[0-9]{{4}}(?:-[0-9]{{4}}){{2}}-[0-9]{{1,7}}"
            rf"|3[0-9]{{3}}[ \-][0-9]{{6}}[ \-][0-9]{{5}}){_END}",
}
ANY = "|".join(PATTERNS.values())
#: Texts without these characters hold no value.
GATE = "[0-9@]"
FIRST_DAY, LAST_DAY = "1000-01-01", "2999-12-31"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(digits: Column, base: int) -> Column:
    found = digits.cast("long") if base == 10 else F.conv(digits, base, 10).cast("long")
    return F.when(F.length(digits) == 0, F.lit(0)).otherwise(found)


def _digits(number: Column, size: Column, base: int) -> Column:
    text = number.cast("string")
    text = text if base == 10 else F.lower(F.conv(text, 10, base))
    return F.when(size == 0, "").otherwise(F.lpad(text, size, "0"))


def feistel(left: Column, right: Column, left_values: Column, right_values: Column, tweak: Column,
            key: str) -> Column:
    """Struct (a, b): the keyed image of a pair of numbers below ``left_values``, ``right_values``."""
    def turn(state: Column, i: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), tweak, i.cast("string"), state["b"].cast("string"))
        noise = F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long")
        values = F.when(i % 2 == 0, state["m"]).otherwise(state["n"])
        return F.struct(state["b"].alias("a"), ((state["a"] + noise % values) % values).alias("b"),
                        state["m"].alias("m"), state["n"].alias("n"))

    start = F.struct(left.alias("a"), right.alias("b"), left_values.alias("m"),
                     right_values.alias("n"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_string(value: Column, tweak: str, key: str, base: int = 10) -> Column:
    """The keyed image of a string of digits of ``base`` (36: lower-case), same length."""
    def image(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        rest = F.length(v) - half
        return let(
            feistel(_number(F.substring(v, F.lit(1), half), base),
                    _number(F.substring(v, half + 1, rest), base),
                    F.pow(F.lit(base), half).cast("long"), F.pow(F.lit(base), rest).cast("long"),
                    F.concat(F.lit(f"{tweak}|{base}|"), F.length(v).cast("string")), key),
            lambda s: F.concat(_digits(s["a"], half, base), _digits(s["b"], rest, base)))

    return let(value, image)


def _walk(value: Column, step: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """``step`` until the result is ``valid``."""
    start = F.struct(value.alias("v"), F.lit(False).alias("done"))

    def turn(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(let(
            step(s["v"]), lambda v: F.struct(v.alias("v"), valid(v).alias("done"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, turn)["v"]


def refill(template: Column, digits: Column, signs: str = "[0-9]") -> Column:
    """``template`` with its digits (or other ``signs``) replaced, in order."""
    return F.array_join(F.flatten(F.zip_with(
        F.split(template, signs, -1), F.split(digits, ""), lambda s, d: F.array(
            s, F.coalesce(d, F.lit(""))))), "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second from the right doubled."""
    def add(total: Column, d: Column) -> Column:
        twice = d["d"] * F.when(d["i"] % 2 == 1, 2).otherwise(1)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    places = F.transform(F.split(F.reverse(digits), ""),
                         lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    return F.aggregate(places, F.lit(0), add)


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str) -> Column:
    def image(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_string(
            F.substring(d, F.lit(2), F.length(d) - 2), "card", key))
        return let(body, lambda b: F.concat(
            b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return let(_only_digits(value), lambda d: F.when(
        (luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$"), refill(value, image(d))))


def _phone(value: Column, key: str) -> Column:
    country = F.regexp_extract(value, COUNTRY_CODE, 0)
    return let(country, lambda c: let(
        F.substring(value, F.length(c) + 1, F.length(value)),
        lambda rest: F.concat(c, refill(rest, permute_string(_only_digits(rest), "phone", key)))))


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an account, letters counting from 10, by ISO 7064 (97, 10)."""
    signs = F.transform(F.split(F.concat(account, country), ""), lambda c: F.conv(c, 36, 10).cast("int"))
    rest = F.aggregate(signs, F.lit(0), lambda r, n: (r * F.when(n > 9, 100).otherwise(10) + n) % 97)
    return F.lpad((98 - rest * 100 % 97).cast("string"), 2, "0")


def _iban(value: Column, key: str) -> Column:
    """Digits and letters of the account, each by their own permutation; new check digits."""
    letters, as_digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdefghijklmnop"
    country = F.substring(value, 1, 2)

    def image(account: Column) -> Column:
        digits = permute_string(_only_digits(account), "iban", key)
        own = F.translate(F.regexp_replace(account, "[^A-Z]", ""), letters, as_digits)
        signs = F.translate(permute_string(own, "iban", key, 26), as_digits, letters)
        return refill(refill(account, digits), signs, "[A-Z]")

    def checked(account: Column) -> Column:
        return let(image(account), lambda a: refill(refill(
            F.concat(F.lit("00"), F.substring(value, F.lit(5), F.length(value))),
            F.concat(iban_check(country, a), _only_digits(a))), F.regexp_replace(a, "[^A-Z]", ""), "[A-Z]"))

    return let(F.regexp_replace(F.substring(value, F.lit(5), F.length(value)), " ", ""), lambda a: F.when(
        iban_check(country, a) == F.substring(value, 3, 2), F.concat(country, checked(a))))


def _ip(value: Column, key: str) -> Column:
    def image(o: Column) -> Column:
        half = F.lit(65536).cast("long")
        return let(
            feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], half, half, F.lit("ip"), key),
            lambda s: F.concat_ws(".", *(x.cast("string") for x in (
                F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))))

    return let(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), image)


def _email(value: Column, key: str) -> Column:
    """Runs of letters and digits before the ``@``, lower-cased; equal addresses stay equal."""
    local = F.lower(F.substring_index(value, "@", 1))
    runs = F.regexp_extract_all(local, F.lit("([0-9]{1,16}(?![a-z0-9])|[a-z0-9]{1,16}|[^a-z0-9]+)"), 1)
    image = F.transform(runs, lambda r: F.when(
        r.rlike("^[0-9]+$"), permute_string(r, "mail", key)).when(
        r.rlike("^[a-z0-9]+$"), permute_string(r, "mail", key, 36)).otherwise(r))
    return F.concat(F.array_join(image, ""), F.lit("@"), F.substring_index(value, "@", -1))


def _ssn(value: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        return ~d.rlike("^(?:000|666|9|...00|.....0000)")

    return let(_only_digits(value), lambda d: F.when(valid(d), refill(
        value, _walk(d, lambda v: permute_string(v, "ssn", key), valid))))


def _date(value: Column, key: str) -> Column:
    """ISO order where the year comes first; otherwise month first after a slash if that is a
    date, else day first."""
    day0 = F.datediff(F.lit(LAST_DAY).cast("date"), F.lit(FIRST_DAY).cast("date")) + 1

    def image(parsed: Column) -> Column:
        days = F.datediff(parsed["day"], F.lit(FIRST_DAY).cast("date"))
        number = _walk(F.lpad(days.cast("string"), 6, "0"),
                       lambda v: permute_string(v, "date", key), lambda v: v.cast("int") < day0)
        return F.when(days.between(0, day0 - 1), let(
            F.date_add(F.lit(FIRST_DAY).cast("date"), number.cast("int")),
            lambda d: F.when(parsed["form"] == 1, F.date_format(d, "yyyy-MM-dd"))
            .when(parsed["form"] == 2, F.date_format(d, "yyyy/MM/dd"))
            .when(parsed["form"] == 3, F.date_format(d, "dd.MM.yyyy"))
            .when(parsed["form"] == 4, F.date_format(d, "MM/dd/yyyy"))
            .otherwise(F.date_format(d, "dd/MM/yyyy"))))

    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy"]
    parsed = F.coalesce(*(
        F.when(F.try_to_timestamp(value, F.lit(form)).isNotNull(), F.struct(
            F.try_to_timestamp(value, F.lit(form)).cast("date").alias("day"), F.lit(i).alias("form")))
        for i, form in enumerate(forms, 1)))
    return let(parsed, image)


_IMAGES = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _replacement(value: Column, key: str) -> Column:
    """Struct (kind, pseudonym); the pseudonym is null where the value is not valid."""
    out = F.lit(None).cast("struct<kind:string,pseudonym:string>")
    for kind in reversed(PATTERNS):
        shape = f"^(?:{PATTERNS[kind]})$"
        out = F.when(value.rlike(shape), F.struct(
            F.lit(kind).alias("kind"), _IMAGES[kind](value, key).alias("pseudonym"))).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with every valid personal value of ``text`` replaced, and ``found``: an array of
    structs (kind, pseudonym) in the order of the text.

    No shuffle: a row stays where it is, however many rows share a value.  Null texts stay null with
    an empty array, as have empty texts and texts without values, which are unchanged.  Invalid
    values (a wrong checksum, the 31st of June) are left alone.  A column named ``found`` is
    replaced; other columns pass.
    """
    # split and regexp_extract_all walk the same matches, so values and what lies between alternate.
    columns = [c for c in docs.columns if c != found]
    hits = docs.select(*columns, F.when(
        F.col(text).rlike(GATE), F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).alias("_hits"))
    images = hits.withColumn("_images", F.when(
        F.size("_hits") > 0, F.transform("_hits", lambda v: _replacement(v, key))))
    between = F.split(F.col(text), ANY, -1)
    values = F.zip_with("_hits", "_images", lambda v, i: F.coalesce(i["pseudonym"], v))
    joined = F.array_join(F.flatten(F.zip_with(
        between, values, lambda b, v: F.array(b, F.coalesce(v, F.lit(""))))), "")
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    return images.select(
        *(F.when(F.col("_images").isNotNull(), joined).otherwise(F.col(text)).alias(text)
          if c == text else F.col(c) for c in columns),
        F.coalesce(F.filter("_images", lambda i: i["pseudonym"].isNotNull()), empty).alias(found))
