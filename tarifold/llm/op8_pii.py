r"""Personal data: format-preserving Feistel pseudonyms, with DataFrame functions only.

One pattern finds candidates in a text: e-mail addresses, IPv4 addresses, dates, phone numbers, social security numbers,
international bank account numbers, card-like digit runs and long hex secrets. Candidates are validated (octets, calendar, ranges) and then permuted by a keyed
Feistel network within their own format: every half is shifted by a keyed hash (SHA-256) of the other half, ROUNDS times, in
the format's own alphabet or range. Equal values thus get equal pseudonyms in all documents, different values different ones.

- Digit runs of 13 to 19: all digits but the last are permuted; the last keeps its distance to the Luhn check digit, so
  valid numbers stay valid and others stay invalid.
- Dates of 1900 to 2099: permuted among the days of these years, in the same notation. Other dates stay.
- IPv4: permuted among all addresses. Social security numbers: among all with valid area, group and serial.
- Phones: the digits after the country code (and a trunk zero in brackets), or else the ten last. After + or 00, 7 to 15 digits
  in any groups are a phone; without, groups of 3, 3 and 4.
- IBAN: letters among letters and digits among digits of the account part; the check digits keep their remainder by 97, so
  valid numbers stay valid and others stay invalid. Written whole or in fours, with the length of its country.
- E-mail: letters and digits of the local part, in their class (digit, lower, upper; letters of other scripts and their digits
  among those of their kind in the same 128 code points). A letter without a companion there stays, as do marks.
- Hex secrets (32 to 64 characters with a digit): digits among digits, letters among a-f or A-F.

Texts aren't shuffled. Cases: a null text stays null, an empty one empty; texts without a candidate are returned as they are;
repeated rows are treated alike; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of 1900 to 2099 as a product, so that the Feistel halves fill the range exactly.
FIRST_DAY, DAYS = "1900-01-01", (229, 319)
EMAIL = r"[\p{L}\p{M}\p{N}._%+-]+@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)+"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
DATE = r"\d{4}-\d{2}-\d{2}(?!\d)|\d{2}[./]\d{2}[./]\d{4}(?!\d)"
SSN = r"\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"
#: Any groups after a country code; a group that begins a date isn't one of them.
ABROAD = r"(?:\+|00(?=[1-9]\d{0,2}[ .(-]))[1-9](?:(?:[ .()/-]{1,3}(?!(?:19|20)\d\d-[01]\d-[0-3]\d|[0-3]\d[./][01]\d[./](?:19|20)\d\d))?\d){6,14}(?!\d)"
#: Country codes of one and two digits; others have three.
COUNTRY_CODE = r"^(?:\+|00)(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3})(?:[ .-]?\(0\))?"
#: Characters of an international bank account number by country (ISO 13616 register).
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban(size: int, countries: str) -> str:
    whole, rest = divmod(size - 4, 4)
    spaced = rf"(?: [A-Z0-9]{{4}}){{{whole}}}" + (rf" [A-Z0-9]{{{rest}}}" if rest else "")
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?:[A-Z0-9]{{{size - 4}}}|{spaced})"


IBAN = rf"(?:{'|'.join(_iban(*x) for x in IBAN_SIZES.items())})(?![\p{{L}}\p{{N}}])"
HEX = r"(?=[a-fA-F]*\d)[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])"
DIGITS = r"\d{13,19}(?!\d)|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?!\d)|\d{4}[ -]\d{6}[ -]\d{5}(?!\d)"
CANDIDATE = rf"(?<![\p{{L}}\p{{N}}])(?:{EMAIL}|{IPV4}|{DATE}|{SSN}|{PHONE}|{ABROAD}|{HEX}|{IBAN}|{DIGITS})"


def keyed(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts]), 256)


def bind(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def permute_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """Struct l, r: a keyed permutation of the pairs below the sizes."""
    def number(r: Column, half: Column) -> Column:
        return F.conv(F.substring(keyed(key, kind, r, half), 1, 12), 16, 10).cast("long")

    def two(a: Column, r: Column) -> Column:
        return bind((a["l"] + number(r, a["r"])) % sizes[0], lambda x: F.struct(x.alias("l"), ((a["r"] + number(-r, x)) % sizes[1]).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, two)


def _classes() -> tuple[str, list[tuple[int, int]]]:
    """Letters and digits beyond ASCII by kind and run of 128 code points: those of mixed runs, a word for each class, and the first and last of runs of one kind."""
    mixed, full = [], []
    for page in range(128, 0x110000, 128):
        kinds = defaultdict(list)
        for c in map(chr, range(page, page + 128)):
            kind = unicodedata.category(c)
            if kind[0] in "LN":
                kinds[kind if kind in ("Lu", "Ll", "Nd") else kind[0]].append(c)
        for kind in [k for k in kinds if len(kinds[k]) == 1]:  # alone of its kind: joins the most of its letters or digits
            others = [k for k in kinds if k != kind and k[0] == kind[0]]
            if others:
                kinds[max(others, key=lambda k: len(kinds[k]))] += kinds.pop(kind)
        for members in kinds.values():
            if len(members) < 128:
                mixed.append("".join(members))
            elif full and full[-1][1] == page - 1:
                full[-1] = (full[-1][0], page + 127)
            else:
                full.append((page, page + 127))
    return " ".join(["", *mixed, ""]), full


MIXED, FULL = _classes()


def moved_abroad(c: Column, by: Column) -> Column:
    """A character beyond ASCII, moved within its class; others stay."""
    code = F.ascii(c)  # its code point
    at = F.instr(F.lit(MIXED), c)
    new = code - code % 128 + (code + by) % 128
    inside = F.lit(False)
    for first, last in FULL:
        inside = inside | code.between(first, last)
    before, after = F.substring_index(F.substr(F.lit(MIXED), F.lit(1), at - 1), " ", -1), F.substring_index(F.substr(F.lit(MIXED), at), " ", 1)
    found = bind(F.struct(F.concat(before, after).alias("all"), F.length(before).alias("at")), lambda m: F.substr(m["all"], (m["at"] + by) % F.length(m["all"]) + 1, F.lit(1)))
    return F.when(inside, F.decode(F.unhex(F.lpad(F.hex(new), 8, "0")), "UTF-32")).when(at > 0, found).otherwise(c)


def shift(text: Column, pad: Column, letters: int, abroad: bool = False) -> Column:
    """Letters and digits of a text, each moved within its class by the digest's next two bytes; beyond ASCII only if abroad."""
    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(pad, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        return (F.when(c.between("0", "9") & (F.octet_length(c) == 1), F.char(48 + (code - 48 + by) % 10))
                .when(c.between("a", "z") & (F.octet_length(c) == 1), F.char(97 + (code - 97 + by) % letters))
                .when(c.between("A", "Z") & (F.octet_length(c) == 1), F.char(65 + (code - 65 + by) % letters))
                .when(F.octet_length(c) > 1, moved_abroad(c, by) if abroad else c).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), moved), "")


def permute_text(text: Column, key: str, kind: str, letters: int = 26, abroad: bool = False) -> Column:
    """A keyed permutation of the texts of the same shape: the halves' characters shift each other's."""
    half = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))

    def two(a: Column, r: Column) -> Column:
        return bind(shift(a["l"], keyed(key, kind, r, a["r"]), letters, abroad), lambda x: F.struct(x.alias("l"), shift(a["r"], keyed(key, kind, -r, x), letters, abroad).alias("r")))

    return bind(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, two), lambda a: F.concat(a["l"], a["r"]))


def luhn_digit(body: Column) -> Column:
    """The check digit that completes a text of digits."""
    doubled = F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return (10 - F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10) % 10


def refill(shape: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """The text with its digits, or what else the kind says, replaced in their order, so that a number has one pseudonym in all its notations."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("k"))

    def put(a: Column, c: Column) -> Column:
        digit = c.rlike(kind)
        return F.struct(F.concat(a["t"], F.when(digit, F.substr(digits, a["k"] + 1, F.lit(1))).otherwise(c)).alias("t"), F.when(digit, a["k"] + 1).otherwise(a["k"]).alias("k"))
    return F.aggregate(F.split(shape, ""), start, put, lambda a: a["t"])


def card(x: Column, key: str) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    body, last = F.substr(digits, F.lit(1), F.length(digits) - 1), F.right(digits, F.lit(1)).cast("int")
    number = bind(permute_text(body, key, "card"), lambda b: F.concat(b, ((luhn_digit(b) + 10 + last - luhn_digit(body)) % 10).cast("string")))
    return bind(number, lambda n: refill(x, n))


def address(x: Column, key: str) -> Column:
    o = F.transform(F.split(x, r"\."), lambda p: p.cast("int"))
    new = bind(permute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ipv4"),
               lambda p: F.concat_ws(".", *[F.floor(p[h] / 256).cast("string") if hi else (p[h] % 256).cast("string") for h in ("l", "r") for hi in (True, False)]))
    return F.when(F.array_max(o) <= 255, new).otherwise(x)


def date(x: Column, key: str) -> Column:
    iso = F.substring(x, 5, 1) == "-"
    sep = F.substring(x, 3, 1)
    plain = F.when(iso, x).otherwise(F.concat_ws("-", F.right(x, F.lit(4)), F.substring(x, 4, 2), F.substring(x, 1, 2)))
    turned = F.when(~iso, F.concat_ws("-", F.right(x, F.lit(4)), F.substring(x, 1, 2), F.substring(x, 4, 2)))

    def write(day: Column, month_first: bool) -> Column:
        other = F.concat(F.date_format(day, "MM" if month_first else "dd"), sep, F.date_format(day, "dd" if month_first else "MM"), sep, F.date_format(day, "yyyy"))
        return F.when(iso, F.date_format(day, "yyyy-MM-dd")).otherwise(other)

    def moved(parsed: Column, month_first: bool) -> Column:
        n = F.datediff(parsed, F.lit(FIRST_DAY).cast("date"))
        pair = permute_pair(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date")
        day = bind(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")))
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), bind(day, lambda d: write(d, month_first)))

    return F.coalesce(moved(F.try_to_date(plain, "yyyy-MM-dd"), False), moved(F.try_to_date(turned, "yyyy-MM-dd"), True), x)


def security_number(x: Column, key: str) -> Column:
    area, group, serial = F.substring(x, 1, 3).cast("int"), F.substring(x, 5, 2).cast("int"), F.substring(x, 8, 4).cast("int")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = permute_pair(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")

    def write(p: Column) -> Column:
        a = F.when(p["l"] >= 665, p["l"] + 2).otherwise(p["l"] + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))
    return F.when(valid, bind(pair, write)).otherwise(x)


def phone(x: Column, key: str) -> Column:
    ten = F.regexp_extract(x, r"^(.*?)(?=(?:[^0-9]*[0-9]){10}[^0-9]*$)", 1)
    head = F.when(x.rlike(r"^(?:\+|00)"), F.regexp_extract(x, COUNTRY_CODE, 0)).otherwise(ten)
    return bind(F.struct(head.alias("h"), F.substr(x, F.length(head) + 1).alias("t")),
                lambda p: F.concat(p["h"], bind(permute_text(F.regexp_replace(p["t"], "[^0-9]", ""), key, "phone"), lambda d: refill(p["t"], d))))


def remainder(text: Column) -> Column:
    """Of the number that a text of digits and capitals stands for (A is 10, Z is 35), by 97."""
    value = F.transform(F.split(text, ""), lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def account(x: Column, key: str) -> Column:
    """Check digits beyond 02 to 98 are never valid and stay."""
    plain = F.regexp_replace(x, " ", "")
    country, check, body = F.substring(plain, 1, 2), F.substring(plain, 3, 2), F.substr(plain, F.lit(5))

    def checked(new: Column) -> Column:
        by = remainder(F.concat(body, country, check)) - remainder(F.concat(new, country, F.lit("00")))
        digits = F.when(check.cast("int").between(2, 98), F.lpad((F.pmod(by - 2, F.lit(97)) + 2).cast("string"), 2, "0")).otherwise(check)
        return F.concat(country, digits, new)
    return bind(bind(permute_text(body, key, "iban"), checked), lambda n: refill(x, n, "[0-9A-Z]"))


def email(x: Column, key: str) -> Column:
    local = F.substring_index(x, "@", 1)
    return F.concat(permute_text(local, key, "email", abroad=True), F.substr(x, F.length(local) + 1))


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one candidate."""
    whole = lambda p: x.rlike(rf"^(?:{p})$")
    return (F.when(whole(EMAIL), email(x, key)).when(whole(IPV4), address(x, key)).when(whole(DATE), date(x, key)).when(whole(SSN), security_number(x, key))
            .when(whole(f"{PHONE}|{ABROAD}"), phone(x, key)).when(whole(HEX), permute_text(x, key, "hex", 6)).when(whole(IBAN), account(x, key)).otherwise(card(x, key)))


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """The rows with their texts' personal data replaced; all columns in their order."""
    text = F.col(text_column)
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))

    def rebuilt(tokens: Column) -> Column:
        gaps = F.split(text, CANDIDATE, -1)
        return F.array_join(F.zip_with(gaps, F.transform(tokens, lambda x: pseudonym(x, key)), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")

    replaced = bind(found, lambda tokens: F.when(F.size(tokens) > 0, rebuilt(tokens)))
    return docs.withColumn(text_column, F.coalesce(replaced, text))
