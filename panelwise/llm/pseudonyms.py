"""Format-preserving pseudonyms for personal data: a keyed Feistel network over the symbols of each value.

Candidates are found with one pattern, validated (Luhn, mod 97, octets, calendar, number of digits) and permuted within
their format: a value's symbols (digits, letters, octets) are split into two halves, and in each round every symbol of one
half is shifted, within its own alphabet, by a keyed hash of the other half. That is a permutation for any key, so equal
values stay equal across documents and different ones stay different; layout, case, separators, e-mail domains, country
codes and check digits stay valid. Dates move within 1900 to 2099, leap days to leap days. Secrets (long hexadecimal or
vendor-prefixed strings, and what follows words like password=) are permuted by character class.

Defined cases: null text stays null; text without candidates is unchanged; candidates that fail validation stay as they
are; each input row gives one row; all other columns are kept, whatever their names. Only text is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# Whoever knows the key can invert the pseudonyms: set one by this Spark setting. The fixed key stands in where a query has none.
KEY_SETTING, FIXED_KEY = "spark.panelwise.pseudonyms.key", "panelwise"
ROUNDS = 6

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
PHONE = (r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
         r"|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])")
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = (r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}[./]\d{1,2}[./]\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{1,2}-\d{1,2}-\d{4})"
        r"(?![\d/-])")
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:(?:\d{4}[ -]){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
SECRET = (r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}"
          r"|xox[abpr]-[A-Za-z0-9-]{10,}"
          r"|(?<=(?:password|passwd|secret|token|api_key|apikey)(?:=|:|: | = )[\"']{0,1})[A-Za-z0-9]{6,})(?![A-Za-z0-9])")
# In this order: what a more telling pattern takes isn't offered to a later one.
KINDS = {"email": EMAIL, "ip": IP, "iban": IBAN, "secret": SECRET, "phone": PHONE, "date": DATE, "ssn": SSN, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
# Every candidate holds one of these or stands behind one, so a text without them is left alone at once.
HINT = r"[0-9@]|[a-f]{32}|AKIA|gh[pousr]_|sk-|xox[abpr]-|password|passwd|secret|token|api_?key"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def digest(key: str, tweak: str, k: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), k.cast("string"), F.array_join(half, ",")), 256)


def feistel(symbols: Column, radices: Column, key: str, tweak: str, rounds: int = ROUNDS) -> Column:
    """Permute an array<int> of symbols, each below its radix. A lone symbol gets a keyed shift that isn't 0."""
    n = F.size(symbols)
    h = F.floor(n / 2).cast("int")

    def one(x: Column, k: Column) -> Column:
        first = (k % 2) == 0
        half = F.when(first, F.slice(x, h + 1, n - h)).otherwise(F.slice(x, F.lit(1), h))

        def shifted(d: Column) -> Column:
            def move(v: Column, i: Column) -> Column:
                radix = F.get(radices, i)
                return F.when((i < h) == first, F.pmod(v + F.pmod(F.xxhash64(d, i), radix), radix).cast("int")).otherwise(v)
            return F.transform(x, move)

        return let(digest(key, tweak, k, half.cast("array<string>")), shifted)

    many = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), symbols, one)
    radix = F.get(radices, F.lit(0))
    lone = F.transform(symbols, lambda v: F.when(radix > 1, F.pmod(
        v + 1 + F.pmod(F.xxhash64(F.lit(key), F.lit(tweak)), F.greatest(radix - 1, F.lit(1))), radix).cast("int")).otherwise(v))
    return F.when(n > 1, many).otherwise(lone)


def permute_text(s: Column, key: str, tweak: str) -> Column:
    """Permute digits among digits and letters among letters of their case; the rest stays in place."""
    def build(chars: Column) -> Column:
        code = lambda c: F.ascii(c)
        start = lambda c: F.when(c.rlike("[0-9]"), F.lit(48)).when(c.rlike("[a-z]"), F.lit(97)).when(
            c.rlike("[A-Z]"), F.lit(65)).otherwise(F.lit(-1))
        radix = lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).when(c.rlike("[A-Za-z]"), F.lit(26)).otherwise(F.lit(1))
        moved = feistel(F.transform(chars, lambda c: F.when(start(c) < 0, F.lit(0)).otherwise(code(c) - start(c))),
                        F.transform(chars, radix), key, tweak)
        return F.array_join(F.zip_with(chars, moved, lambda c, v: F.when(start(c) < 0, c).otherwise(F.char(start(c) + v))), "")
    return F.when(F.length(s) > 0, let(F.filter(F.split(s, ""), lambda c: c != ""), build)).otherwise(s)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit, from the last but one, doubled."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    worth = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(worth, F.lit(0), lambda a, v: a + v)


def card(s: Column, key: str) -> Column:
    """Issuer digit kept, the rest permuted, check digit recomputed."""
    def with_check(body: Column) -> Column:
        return F.concat(body, ((10 - luhn_sum(F.concat(digits_of(body), F.lit("0"))) % 10) % 10).cast("string"))
    body = F.concat(F.left(s, F.lit(1)), permute_text(F.substring(s, F.lit(2), F.length(s) - 2), key, "card"))
    return F.when(luhn_sum(digits_of(s)) % 10 == 0, let(body, with_check)).otherwise(s)


def ip(s: Column, key: str) -> Column:
    octets = F.transform(F.split(s, r"\."), lambda o: o.cast("int"))
    return let(octets, lambda x: F.when(F.forall(x, lambda o: o < 256), F.array_join(
        feistel(x, F.array_repeat(F.lit(256), 4), key, "ip").cast("array<string>"), ".")).otherwise(s))


def mod97(s: Column) -> Column:
    """Remainder of an IBAN-ordered string, letters counting from 10."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    number = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")))
    return F.aggregate(number, F.lit(0), lambda a, v: ((a * F.when(F.length(v) > 1, F.lit(100)).otherwise(F.lit(10))
                                                        + v.cast("int")) % 97).cast("int"))


def iban(s: Column, key: str) -> Column:
    """Country kept, account permuted, check digits recomputed."""
    plain = lambda x: F.regexp_replace(x, " ", "")
    ordered = lambda x: F.concat(F.substring(plain(x), F.lit(5), F.length(x)), F.left(x, F.lit(4)))
    body = permute_text(F.substring(s, F.lit(5), F.length(s)), key, "iban")

    def with_check(b: Column) -> Column:
        check = 98 - mod97(F.concat(plain(b), F.left(s, F.lit(2)), F.lit("00")))
        return F.concat(F.left(s, F.lit(2)), F.lpad(check.cast("string"), 2, "0"), b)
    return F.when(mod97(ordered(s)) == 1, let(body, with_check)).otherwise(s)


def phone(s: Column, key: str) -> Column:
    """Country code kept where the number is written with one; at most 15 digits."""
    code = F.regexp_extract(s, r"^(\+\d{1,3}(?=\D)|\+\d|)", 1)
    n = F.length(digits_of(s))
    return F.when(n.between(8, 15), F.concat(code, permute_text(
        F.substring(s, F.length(code) + 1, F.length(s)), key, "phone"))).otherwise(s)


def ssn(s: Column, key: str) -> Column:
    """Area, group and serial number are symbols among their valid values, so that a pseudonym is never one of the invalid numbers."""
    def shown(x: Column) -> Column:
        area = F.get(x, 0) + 1
        parts = ((F.when(area >= 666, area + 1).otherwise(area), 3), (F.get(x, 1) + 1, 2), (F.get(x, 2) + 1, 4))
        return F.concat_ws("-", *[F.lpad(v.cast("string"), n, "0") for v, n in parts])
    area, group, serial = (F.get(F.split(s, "-"), F.lit(i)).cast("int") for i in range(3))
    symbols = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    moved = feistel(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
    return F.when(s.rlike(r"^(?:000|666|9)|-00-|-0000$"), s).otherwise(let(moved, shown))


def secret(s: Column, key: str) -> Column:
    """Hexadecimal strings by digit and by letter a-f; vendor prefixes stay."""
    prefix = F.regexp_extract(s, r"^(AKIA|gh[pousr]_|sk-|xox[abpr]-|)", 1)

    def as_hex(chars: Column) -> Column:
        value = F.transform(chars, lambda c: F.conv(c, 16, 10).cast("int"))
        moved = feistel(value, F.transform(chars, lambda c: F.lit(16)), key, "hex")
        return F.array_join(F.transform(moved, lambda v: F.lower(F.hex(v.cast("long")))), "")
    other = F.concat(prefix, permute_text(F.substring(s, F.length(prefix) + 1, F.length(s)), key, "secret"))
    return F.when((prefix == "") & s.rlike("^[0-9a-f]+$"), let(F.filter(F.split(s, ""), lambda c: c != ""), as_hex)).otherwise(other)


def date(s: Column, key: str) -> Column:
    """A day moves to another day from 1900 to 2099: (year, day of year) are two symbols; a 366th day stays one.

    The year comes first or last. Last, the day is before the month; where that is no day of the calendar the month is first, and
    the day moves to one after the 12th, so that it can't be read the other way either: (year, place among those days of a year)
    are two symbols, the 29th of February stays one. Parts of two digits keep two.
    """
    part = lambda i: F.get(F.split(s, "[./-]"), F.lit(i))
    day_of = lambda *i: F.try_to_timestamp(F.concat_ws("-", *[part(k) for k in i]), F.lit("yyyy-M-d")).cast("date")
    iso = s.rlike(r"^\d{4}")
    usual_day, month_first = F.when(iso, day_of(0, 1, 2)).otherwise(day_of(2, 1, 0)), F.when(~iso, day_of(2, 0, 1))
    mark = F.regexp_extract(s, r"^\d+(\D)", 1), F.regexp_extract(s, r"(\D)\d+$", 1)
    wide = lambda n, i: F.when(F.length(part(i)) > 1, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    late = F.array(*[F.lit(n) for n in (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)])  # of days after a month's 12th

    def text(first: Column, second: Column, third: Column) -> Column:
        return F.concat(first, mark[0], second, mark[1], third)

    def move(d: Column) -> Column:
        year, number = F.year(d) - 1900, F.dayofyear(d) - 1
        usual = feistel(F.array(year, number), F.array(F.lit(200), F.lit(365)), key, "date")
        leap = F.floor(year / 4).cast("int") - 1  # 1904 is the first of the 49 leap years from 1904 to 2096
        last = feistel(F.array(leap), F.array(F.lit(49)), key, "leap")
        moved = F.when(number < 365, let(usual, lambda x: F.date_add(
            F.make_date(F.get(x, 0) + 1900, F.lit(1), F.lit(1)), F.get(x, 1)))).otherwise(
            F.make_date((F.get(last, 0) + 1) * 4 + 1900, F.lit(12), F.lit(31)))
        return F.when(year.between(0, 199), let(moved, lambda m: F.when(iso, text(
            F.date_format(m, "yyyy"), wide(F.month(m), 1), wide(F.day(m), 2))).otherwise(text(
                wide(F.day(m), 0), wide(F.month(m), 1), F.date_format(m, "yyyy"))))).otherwise(s)

    def move_month_first(d: Column) -> Column:
        year = F.year(d) - 1900
        place = F.get(late, F.month(d) - 1) + F.day(d) - 13
        leap = feistel(F.array(F.floor(year / 4).cast("int") - 1), F.array(F.lit(49)), key, "leap")
        usual = feistel(F.array(year, place), F.array(F.lit(200), F.lit(221)), key, "month first")

        def shown(x: Column) -> Column:
            month = F.size(F.filter(late, lambda n: n <= F.get(x, 1)))
            return text(wide(month, 0), (F.get(x, 1) - F.get(late, month - 1) + 13).cast("string"), (F.get(x, 0) + 1900).cast("string"))
        moved = F.when((F.month(d) == 2) & (F.day(d) == 29), text(part(0), part(1), ((F.get(leap, 0) + 1) * 4 + 1900).cast("string"))).otherwise(
            let(usual, shown))
        return F.when(year.between(0, 199), moved).otherwise(s)

    return F.when(usual_day.isNotNull(), let(usual_day, move)).when(month_first.isNotNull(), let(month_first, move_month_first)).otherwise(s)


def email(s: Column, key: str) -> Column:
    at = F.instr(s, "@")
    return F.concat(permute_text(F.left(s, at - 1), key, "email"), F.substring(s, at, F.length(s)))


def kind_of(s: Column) -> Column:
    out = F.when(s.contains("@"), F.lit("email"))
    for name, pattern in KINDS.items():
        if name != "email":
            out = out.when(s.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out.otherwise(F.lit("secret"))  # found by what stands before it


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of one candidate, or the candidate if it isn't valid."""
    makers = {"email": email, "ip": ip, "iban": iban, "secret": secret, "phone": phone, "date": date, "ssn": ssn, "card": card}

    def by_kind(kind: Column) -> Column:
        out = None
        for name, make in makers.items():
            out = F.when(kind == name, make(s, key)) if out is None else out.when(kind == name, make(s, key))
        return out.otherwise(s)
    return let(kind_of(s), by_kind)


def key_of(spark) -> str:
    return spark.conf.get(KEY_SETTING, FIXED_KEY)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs, ``text`` with its personal data replaced under ``key``."""
    text = F.col("text")
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    woven = F.zip_with(gaps, F.transform(found, lambda s: pseudonym(s, key)), lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))
    return docs.withColumn("text", F.when(text.rlike(HINT), F.array_join(F.flatten(woven), "")).otherwise(text))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymize(docs, key_of(spark))
