"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Numbers and dates that pass their checks are permuted within their format by a keyed
Feistel network, so that equal values stay equal across documents, different ones stay
different, and a card still passes the Luhn test, an address stays an address and a
date a date.  A value x of a domain of a * b values is split into (x div b, x mod b);
each round adds, modulo its size, a keyed hash of one part to the other.  Where the
valid values are fewer than a * b, the permutation is repeated until it gives a valid
one (cycle walking), which keeps it a permutation of the valid values.

E-mail addresses are no numbers: they are replaced by a keyed hash in their form.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents

ROUNDS = 8
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")

# The patterns of candidates; what they find is checked before it is replaced.
# A name begins where no character of a name stands before it and is taken whole, so that each place is read once; a domain
# has at most 127 labels, which also bounds the matcher's stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,}"
# Lengths of the IBANs of a country as registered; what follows one is another value.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + f"(?: ?[A-Z0-9]{{{n % 4}}})" * (n % 4 > 0) for n, c in IBAN_LENGTHS.items())
# Other codes, and other lengths: the longest candidate of digits.
IBAN = rf"\b(?=[A-Z]{{2}}\d{{2}})(?:(?:{_KNOWN})\b|[A-Z]{{2}}\d{{2}}(?: ?\d{{4}}){{2,7}}(?: ?\d{{1,3}})?\b)"
DATE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{4}\b|\b\d{1,2}\.\d{1,2}\.\d{4}\b"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d{4}[ -]?){3}\d{4}\b|\b\d{4}[ -]?\d{6}[ -]?\d{5}\b|\b\d{13,19}\b"


def _marks(least: int, most: int) -> str:
    """So many digits and what is between them; a look-behind needs it without counted groups."""
    one = r"[ .()-]{0,3}\d"
    return one * least + f"(?:{one}" * (most - least) + ")?" * (most - least)


# A number with a country code: +1 has ten digits; others have 7 to 15 with the code, as many groups as fit, but end
# before another value, and before a year after eight digits, unless what is left would be too short.
_STOP = rf"(?!{IP}|{DATE}|{SSN}|{CARD}|(?<=\+\d{{1,3}}[ .(-]{_marks(8, 14)} )(?:19|20)\d{{2}}(?!\d))"
_SIZE = rf"(?!\d)(?<=\+{_marks(7, 15)})(?<=\+(?:\d{{1,3}}(?=[ .(-])|(?!\d{{1,3}}[ .(-])){_marks(7, 15)})"
_BEGIN, _GROUP = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?", r"\d{2,4}"
_ABROAD = rf"\+1[ .-]?\(?\d{{3}}\)?[ .-]?\d{{3}}[ .-]?\d{{4}}(?!\d)|{_BEGIN}(?:[ .-]?{_STOP}{_GROUP}){{2,4}}{_SIZE}|{_BEGIN}(?:[ .-]?{_GROUP}){{2,4}}{_SIZE}"
# Country codes of telephone numbers, of which none begins another: those of one and two digits, else three.
COUNTRY = r"1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
PHONE = rf"{_ABROAD}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}\b|\b\d{{3}}[.-]\d{{3}}[.-]\d{{4}}\b"
ANY = "|".join((EMAIL, IBAN, DATE, IP, SSN, PHONE, CARD))

#: Days from 1900-01-01 to 2099-12-31.
FIRST_DAY, DAYS = -25567, 73049


def feistel(x: Column, a: int | Column, b: int | Column, label: str, key: str) -> Column:
    """The keyed permutation of x in [0, a * b)."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))

    def noise(value: Column, i: Column, size: Column) -> Column:
        text = F.concat_ws(":", F.lit(f"{key}:{label}"), size.cast("string"), i.cast("string"), value.cast("string"))
        return F.pmod(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long"), size)

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + noise(s["r"], i, a), a)
        return F.when(i % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + noise(s["l"], i, b), b).alias("r")))

    begin = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step, lambda s: s["l"] * b + s["r"])


def walk(x: Column, permute: Callable[[Column], Column], valid: Callable[[Column], Column], most: int) -> Column:
    """Permute until valid; ``most`` steps are never all needed in practice."""
    first = F.struct(x.alias("x"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        y = permute(s["x"])
        return F.when(s["done"], s).otherwise(F.transform(F.array(y), lambda v: F.struct(v.alias("x"), valid(v).alias("done")))[0])

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, step, lambda s: s["x"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def permuted_digits(d: Column, label: str, key: str) -> Column:
    """A string of 2 to 18 digits for one of the same length."""
    n = F.length(d)
    low = F.floor(n / 2).cast("int")
    y = feistel(d.cast("long"), _power(n - low), _power(low), label, key)
    return F.lpad(y.cast("string"), n, "0")


def refill(m: Column, d: Column, replaced: str = "0-9") -> Column:
    """The match with its characters of a class (digits) replaced, in order, by those of d."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(f"^[{replaced}]$")
        return F.struct(F.concat(s["out"], F.when(hit, F.substr(d, s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["at"] + hit.cast("int")).alias("at"))

    return F.aggregate(F.split(m, ""), state, step, lambda s: s["out"])


def luhn_sum(d: Column, double_last: bool) -> Column:
    """Luhn sum of the digits; the last one is doubled if a check digit is still to follow."""
    parity = 0 if double_last else 1

    def part(c: Column, i: Column) -> Column:
        v = c.cast("int")
        w = F.when(i % 2 == parity, v * 2).otherwise(v)
        return w - F.when(w > 9, 9).otherwise(0)

    terms = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), part)
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x)


def _valid_date(y: Column, m: Column, d: Column) -> Column:
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0), 29).otherwise(28)).otherwise(31)
    return y.between(1900, 2099) & m.between(1, 12) & d.between(1, longest)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^\\d{4}-")
    parts = F.split(m, "[-/.]")
    y = F.when(iso, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2))).cast("int")
    p, q = F.get(parts, F.lit(1)).cast("int"), F.when(iso, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0))).cast("int")
    # Day first; with slashes month first if only that is a date.
    swapped = ~_valid_date(y, p, q) & m.contains("/") & _valid_date(y, q, p)
    month, day = F.when(swapped, q).otherwise(p), F.when(swapped, p).otherwise(q)
    ok = _valid_date(y, p, q) | swapped
    x = F.unix_date(F.make_date(y, month, day)).cast("long") - FIRST_DAY
    new = F.date_from_unix_date((walk(x, lambda v: feistel(v, 271, 270, "date", key), lambda v: v < DAYS, 12) + FIRST_DAY).cast("int"))
    sep = F.when(m.contains("/"), "/").otherwise(".")
    local = F.when(swapped, F.concat(F.date_format(new, "MM"), sep, F.date_format(new, "dd"))).otherwise(F.concat(F.date_format(new, "dd"), sep, F.date_format(new, "MM")))
    out = F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(F.concat(local, sep, F.date_format(new, "yyyy")))
    return F.when(ok, out)


def _ip(m: Column, key: str) -> Column:
    o = [F.get(F.split(m, "\\."), F.lit(k)).cast("long") for k in range(4)]
    x = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    y = feistel(x, 65536, 65536, "ip", key)
    out = F.transform(F.array(y), lambda v: F.concat_ws(".", *[F.shiftrightunsigned(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))[0]
    return F.when((o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256), out)


def _ssn_valid(x: Column) -> Column:
    area, group, serial = F.floor(x / 1_000_000), F.floor(x / 10_000) % 100, x % 10_000
    return (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)


def _ssn(m: Column, key: str) -> Column:
    x = digits_of(m).cast("long")
    y = walk(x, lambda v: feistel(v, 100_000, 10_000, "ssn", key), _ssn_valid, 40)
    return F.when(_ssn_valid(x), refill(m, F.lpad(y.cast("string"), 9, "0")))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the national digits are permuted alone, so that a number is the same one however it is written."""
    head = F.regexp_extract(m, rf"^(\+(?:{COUNTRY}))?", 0)
    rest = F.substr(m, F.length(head) + 1)
    d = digits_of(rest)
    return F.when(F.length(d).between(4, 15) & F.length(digits_of(m)).between(7, 18), F.concat(head, refill(rest, permuted_digits(d, "phone", key))))


def _card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), "card", key)
    out = F.transform(F.array(body), lambda v: F.concat(v, ((10 - luhn_sum(v, True) % 10) % 10).cast("string")))[0]
    return F.when(F.length(d).between(13, 19) & (luhn_sum(d, False) % 10 == 0), refill(m, out))


def _mod97(d: Column) -> Column:
    """The remainder by 97, with letters as 10 to 35."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(d, ""), lambda c: c != ""), F.lit(0), step)


def _permuted_letters(c: Column, key: str) -> Column:
    """A string of letters for one of the same length, in parts of at most 8."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def part(k: Column) -> Column:
        p = F.substr(c, k + 1, F.lit(8))
        n = F.length(p)
        x = F.aggregate(F.split(p, ""), F.lit(0).cast("long"), lambda s, v: s * 26 + F.ascii(v) - 65)
        y = feistel(x, F.pow(F.lit(26), F.ceil(n / 2)).cast("long"), F.pow(F.lit(26), F.floor(n / 2)).cast("long"), "iban-letters", key)
        return F.transform(F.array(y), lambda v: F.array_join(F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.substr(alphabet, (F.floor(v / F.pow(F.lit(26), i)) % 26 + 1).cast("int"), F.lit(1))), ""))[0]

    return F.when(F.length(c) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.length(c) - 1, F.lit(8)), part), "")).otherwise("")


def _permuted_account(d: Column, key: str) -> Column:
    """Digits by halves of at most 15; the halves of fewer than 4 digits are one number."""
    half = F.floor(F.length(d) / 2).cast("int")
    halves = F.concat(permuted_digits(F.substr(d, F.lit(1), half), "iban-1", key), permuted_digits(F.substr(d, half + 1), "iban-2", key))
    return F.when(F.length(d) >= 4, halves).when(F.length(d) >= 2, permuted_digits(d, "iban-1", key)).when(F.length(d) == 1, feistel(d.cast("long"), 10, 1, "iban-1", key).cast("string")).otherwise("")


def _iban(m: Column, key: str) -> Column:
    """The account's digits and letters are permuted within their classes, and the check digits computed anew."""
    bare = F.regexp_replace(m, " ", "")
    country = F.substring(bare, 1, 2)
    code = F.concat(*[(F.ascii(F.substring(country, k, 1)) - 55).cast("string") for k in (1, 2)])
    account = F.substr(bare, F.lit(5))
    letters = F.regexp_replace(account, "[0-9]", "")
    new = refill(account, _permuted_account(digits_of(account), key))
    new = F.when(letters == "", new).otherwise(refill(new, _permuted_letters(letters, key), "A-Z"))
    out = F.transform(F.array(new), lambda v: F.concat(F.lpad((98 - _mod97(F.concat(v, code, F.lit("00")))).cast("string"), 2, "0"), v))[0]
    ok = (_mod97(F.concat(account, code, F.substring(bare, 3, 2))) == 1) & F.length(account).between(8, 30)
    return F.when(ok, F.concat(country, refill(F.substr(m, F.lit(3)), out, "A-Z0-9")))


def _email(m: Column, key: str) -> Column:
    h = F.sha2(F.concat(F.lit(f"{key}:email:"), F.lower(m)).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@h"), F.substring(h, 13, 8), F.lit(".example"))


def kind_of(m: Column) -> Column:
    full = lambda p: m.rlike(f"^(?:{p})$")
    return F.when(m.contains("@"), "email").when(full(IBAN), "iban").when(full(DATE), "date").when(full(IP), "ip").when(full(SSN), "ssn").when(full(PHONE), "phone").otherwise("card")


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The match's pseudonym, or null if it is not valid."""
    out = F.when(kind == "email", _email(m, key))
    for name, make in (("iban", _iban), ("date", _date), ("ip", _ip), ("ssn", _ssn), ("phone", _phone), ("card", _card)):
        out = out.when(kind == name, make(m, key))
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out_col: str | None = None) -> DataFrame:
    """The documents with personal data in the text replaced, and a column n_<kind> for each of KINDS.

    ``key`` is secret: who has it can undo the permutations.

    E-mail addresses, IBANs (modulo 97), dates from 1900 to 2099, IPv4 addresses, social
    security numbers, telephone numbers (7 to 15 digits) and card numbers (Luhn) are
    replaced if they pass their check; other text stays as it is, byte for byte.  An
    IBAN has the length of its country, its account digits and letters; a telephone number ends before an address, a
    date, a card or a year that follows it (other groups of 2 to 4 digits right after a
    number that is not of +1 are taken as part of it, up to 15 digits).  Equal
    values get equal pseudonyms under the same key, in whatever document; a telephone number
    with a country code is the same value whatever separates its digits.  A null text
    stays null, with counts of 0.  Rows, repeated ones too, and other columns stay as
    they are, but for columns with the names of the counts, which are replaced.
    """
    text = F.col(text_col).cast("string")
    held = f"found_{uuid.uuid4().hex}"
    marked = F.coalesce(text.rlike("[0-9@]"), F.lit(False))
    found = F.when(marked, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kinds = F.transform(held, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    fixed = F.transform(held, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), pseudonym(x["m"], x["kind"], key).alias("new")))
    rows = docs.withColumn(held, found).withColumn(held, kinds).withColumn(held, fixed)
    parts = F.split(text, ANY, -1)
    joined = F.concat_ws("", F.zip_with(parts, held, lambda p, x: F.concat(F.coalesce(p, F.lit("")), F.coalesce(x["new"], x["m"], F.lit("")))))
    new = F.when(F.size(held) > 0, joined).otherwise(text)

    def count(kind: str) -> Column:
        return F.size(F.filter(held, lambda x: (x["kind"] == kind) & x["new"].isNotNull()))

    counts = {f"n_{k}": count(k) for k in KINDS}
    return rows.withColumns({**counts, out_col or text_col: new}).drop(held)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data; the key is the session's, or one for synthetic data."""
    key = spark.conf.get("spark.tessella.pii.key", "synthetic data")
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key)
