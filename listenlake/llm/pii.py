"""Personal numbers, dates and addresses replaced by format-preserving Feistel pseudonyms.

What looks like a number of a known kind and passes its check (Luhn, mod 97, octets, calendar,
number ranges) is permuted, under a key, among the valid values of its format: a card number
becomes another of the same length and first digit with a right check digit, a date another date
written alike.  Equal values get equal pseudonyms in all documents, different values different
ones, and the key undoes it (but for slash dates that only read as day/month/year: their
pseudonym may read as month/day).  What fails its check stays.

Null text stays null with counts of 0, empty text stays empty.  Each row is treated by itself:
repeated rows come out alike, an empty table stays empty, extra columns are kept and columns
named like a count are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.text import let

#: Rounds of the Feistel network.
ROUNDS = 8
#: The key's default is for tests; real runs pass their own.
KEY = "listenlake-test-key"
#: Days from EPOCH are permuted inside blocks of DAY_SIDE squared.
EPOCH, DAY_SIDE = "1900-01-01", 270
#: Years a date may have.
FIRST_YEAR, LAST_YEAR = 1500, 2499

# How long the IBANs of each country are.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """IBANs at the length of their country, so that what follows is not taken in; other countries' at any length."""
    def own(length: int, countries: str) -> str:
        groups, rest = divmod(length - 4, 4)
        spaced = rf"(?: [A-Z0-9]{{4}}){{{groups}}}" + (rf" [A-Z0-9]{{{rest}}}" if rest else "")
        return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})"

    listed = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,4}})?)"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(own(*x) for x in IBAN_LENGTHS.items())}|{other})(?![A-Za-z0-9])"


# How each kind is written.  Earlier kinds win where two begin at one place.
PATTERNS = {
    # The domain is one run of a class, not a repeated group: Java matches a repeated group by recursion,
    # and a domain of thousands of labels overflowed the stack.  So a domain with ".." inside is taken too.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-](?:[A-Za-z0-9.-]*[A-Za-z0-9-])?\.[A-Za-z]{2,}+",
    "iban": iban_pattern(),
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/.])(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
NOT_ALNUM = r"[^A-Za-z0-9]"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 512)


def number_of(hex_: Column, start, length: int) -> Column:
    return F.conv(F.substr(hex_, start, F.lit(length)), 16, 10).cast("long")


def rounds(inverse: bool) -> Column:
    return F.array(*[F.lit(r) for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])


def permute_pair(left: Column, right: Column, left_of: int, right_of: int, key: Column, kind: str, inverse: bool) -> Column:
    """A keyed permutation of (left, right) with left < left_of and right < right_of, as a struct."""
    sign = -1 if inverse else 1

    def step(s, r):
        on_left = r % 2 == 0
        add = number_of(digest(key, F.lit(kind), r, F.when(on_left, s["right"]).otherwise(s["left"])), F.lit(1), 14)
        return F.struct(
            F.when(on_left, F.pmod(s["left"] + sign * add, F.lit(left_of).cast("long"))).otherwise(s["left"]).alias("left"),
            F.when(on_left, s["right"]).otherwise(F.pmod(s["right"] + sign * add, F.lit(right_of).cast("long"))).alias("right"),
        )

    return F.aggregate(rounds(inverse), F.struct(left.cast("long").alias("left"), right.cast("long").alias("right")), step)


def permute_text(value: Column, key: Column, kind: str, inverse: bool) -> Column:
    """A keyed permutation of strings: each letter or digit becomes another of its class, all else stays.

    The halves are the letters and digits at even and at odd places; a round shifts one half by
    amounts drawn from the other.
    """
    sign = -1 if inverse else 1
    code = lambda c: F.ascii(c)
    base = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).otherwise(97)
    size = lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26)

    def permuted(plain: Column) -> Column:
        chars = F.filter(F.split(plain, ""), lambda c: c != "")

        def step(now, r):
            still = F.concat_ws(",", F.transform(F.filter(now, lambda v, i: i % 2 != r % 2), lambda v: v["v"].cast("string")))
            return let(digest(key, F.lit(kind), r, F.size(now), still), lambda h: F.transform(now, lambda v, i: F.struct(
                v["base"].alias("base"), v["of"].alias("of"),
                F.when(i % 2 == r % 2, F.pmod(v["v"] + sign * number_of(h, (F.floor(i / 2) % 32 * 4 + 1).cast("int"), 4), v["of"])).otherwise(v["v"]).alias("v"),
            )))

        start = F.transform(chars, lambda c: F.struct(
            base(c).alias("base"), size(c).cast("long").alias("of"), (code(c) - base(c)).cast("long").alias("v")))
        return F.array_join(F.transform(F.aggregate(rounds(inverse), start, step), lambda v: F.char(v["base"] + v["v"])), "")

    return let(permuted(F.regexp_replace(value, NOT_ALNUM, "")), lambda new: fill(value, new))


def fill(mask: Column, new: Column) -> Column:
    """`mask` with its letters and digits replaced in order by those of `new`: the signs between them, zipped with them; linear in length."""
    between = F.split(mask, "[A-Za-z0-9]", -1)
    chars = F.concat(F.filter(F.split(new, ""), lambda c: c != ""), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, chars, lambda sign, c: F.concat(F.coalesce(sign, F.lit("")), F.coalesce(c, F.lit("")))), "")


def luhn(digits: Column) -> Column:
    """Weighted digit sum modulo 10: 0 for a valid number."""
    def weigh(d):
        return F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")), lambda s, c: F.struct(
        (s["sum"] + F.when(s["i"] % 2 == 0, c.cast("int")).otherwise(weigh(c.cast("int")))).alias("sum"), (s["i"] + 1).alias("i")
    ), lambda s: s["sum"] % 10)


def mod97(letters: Column) -> Column:
    """The number written by digits and letters (A is 10) modulo 97."""
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def card(value: Column, key: Column, inverse: bool) -> Column:
    def made(d):
        inner = permute_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", inverse)
        return let(F.concat(F.substr(d, F.lit(1), F.lit(1)), inner), lambda head: let(
            luhn(F.concat(head, F.lit("0"))), lambda s: fill(value, F.concat(head, ((10 - s) % 10).cast("string")))))

    return let(F.regexp_replace(value, NOT_ALNUM, ""), lambda d: F.when((luhn(d) == 0) & ~d.rlike("^0+$"), made(d)))


def iban(value: Column, key: Column, inverse: bool) -> Column:
    def made(d):
        country = F.substr(d, F.lit(1), F.lit(2))
        return let(permute_text(F.substr(d, F.lit(5), F.length(d) - 4), key, "iban", inverse), lambda own: let(
            98 - mod97(F.concat(own, country, F.lit("00"))), lambda check: fill(value, F.concat(country, F.lpad(check.cast("string"), 2, "0"), own))))

    return let(F.regexp_replace(value, NOT_ALNUM, ""), lambda d: F.when(
        mod97(F.concat(F.substr(d, F.lit(5), F.length(d) - 4), F.substr(d, F.lit(1), F.lit(4)))) == 1, made(d)))


def ip(value: Column, key: Column, inverse: bool) -> Column:
    part = lambda p, i: F.get(p, F.lit(i)).cast("int")

    def made(p):
        pair = permute_pair(part(p, 0) * 256 + part(p, 1), part(p, 2) * 256 + part(p, 3), 65536, 65536, key, "ip", inverse)
        return let(pair, lambda s: F.concat_ws(".", *[x.cast("long").cast("string") for half in ("left", "right") for x in (
            F.floor(s[half] / 256), s[half] % 256)]))

    return let(F.split(value, r"\."), lambda p: F.when(F.forall(p, lambda x: x.cast("int") <= 255), made(p)))


def date(value: Column, key: Column, inverse: bool) -> Column:
    """ISO dates, day.month.year, and month/day/year (day/month/year where only that is a date)."""
    def calendar(y, m, d):
        text = F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        return F.when(y.cast("int").between(FIRST_YEAR, LAST_YEAR), text.try_cast("date"))

    def new_day(day):
        number = F.datediff(day, F.lit(EPOCH).cast("date"))
        block, rest = F.floor(number / DAY_SIDE ** 2), F.pmod(number, F.lit(DAY_SIDE ** 2))
        pair = permute_pair(F.floor(rest / DAY_SIDE), rest % DAY_SIDE, DAY_SIDE, DAY_SIDE, key, "date", inverse)
        return let(pair, lambda s: F.date_add(F.lit(EPOCH).cast("date"), (block * DAY_SIDE ** 2 + s["left"] * DAY_SIDE + s["right"]).cast("int")))

    def written(day, order, sign, p):
        one = F.length(F.get(p, F.lit(0))) + F.length(F.get(p, F.lit(1))) < 4
        short = {"d": F.dayofmonth(day), "m": F.month(day)}
        parts = [F.when(one, short[x].cast("string")).otherwise(F.lpad(short[x].cast("string"), 2, "0")) for x in order]
        return F.concat_ws(sign, *parts, F.lpad(F.year(day).cast("string"), 4, "0"))

    def choose(p):
        a, b, c = (F.get(p, F.lit(i)) for i in range(3))
        iso, dots = calendar(a, b, c), calendar(c, b, a)
        american = calendar(c, a, b)
        return F.when(value.contains("-"), let(iso, lambda d: F.when(d.isNotNull(), let(new_day(d), lambda n: F.date_format(n, "yyyy-MM-dd"))))) \
            .when(value.contains("."), let(dots, lambda d: F.when(d.isNotNull(), let(new_day(d), lambda n: written(n, "dm", ".", p))))) \
            .when(american.isNotNull(), let(american, lambda d: let(new_day(d), lambda n: written(n, "md", "/", p)))) \
            .otherwise(let(dots, lambda d: F.when(d.isNotNull(), let(new_day(d), lambda n: written(n, "dm", "/", p)))))

    return let(F.split(value, "[-/.]"), choose)


def ssn(value: Column, key: Column, inverse: bool) -> Column:
    """Areas 001 to 899 without 666, groups from 01, serials from 0001."""
    def made(p):
        area, group, serial = (F.get(p, F.lit(i)).cast("int") for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = area - 1 - F.when(area > 666, 1).otherwise(0)
        pair = permute_pair(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", inverse)

        def show(s):
            index = F.floor(s["left"] / 99)
            number = index + 1 + F.when(index >= 665, 1).otherwise(0)
            return F.concat_ws("-", F.lpad(number.cast("string"), 3, "0"), F.lpad((s["left"] % 99 + 1).cast("string"), 2, "0"),
                               F.lpad((s["right"] + 1).cast("string"), 4, "0"))

        return F.when(valid, let(pair, show))

    return let(F.split(value, "-"), made)


def phone(value: Column, key: Column, inverse: bool) -> Column:
    """All digits behind the country code."""
    code = r"^(\+[0-9]{1,3}(?=[^0-9])|\+[0-9]|)"
    return F.concat(F.regexp_extract(value, code, 1), permute_text(F.regexp_replace(value, code, ""), key, "phone", inverse))


def email(value: Column, key: Column, inverse: bool) -> Column:
    """The part before the @; the domain stays."""
    return F.concat(permute_text(F.substring_index(value, "@", 1), key, "email", inverse), F.lit("@"), F.substring_index(value, "@", -1))


KINDS = {"email": email, "iban": iban, "card": card, "ip": ip, "date": date, "ssn": ssn, "phone": phone}


def kind_of(value: Column) -> Column:
    found = None
    for kind, pattern in PATTERNS.items():
        fits = value.rlike(rf"^(?:{pattern})$")
        found = F.when(fits, F.lit(kind)) if found is None else found.when(fits, F.lit(kind))
    return found


def pseudonym(value: Column, key: Column, inverse: bool) -> Column:
    """Struct (kind, text): the pseudonym of a found value, or a null kind and the value if its check fails."""
    def made(kind):
        new = None
        for name, function in KINDS.items():
            here = function(value, key, inverse)
            new = F.when(kind == name, here) if new is None else new.when(kind == name, here)
        return let(new, lambda n: F.struct(F.when(n.isNotNull(), kind).alias("kind"), F.coalesce(n, value).alias("text")))

    return let(kind_of(value), made)


def pseudonymize(docs: DataFrame, key: str = KEY, text: str = "text", inverse: bool = False) -> DataFrame:
    """`docs` with its text rewritten and n_<kind> counted for each kind; one projection, no shuffle.

    `inverse` undoes it with the same key.
    """
    body, secret = F.col(text), F.lit(key)
    # The pattern's own group is for repeated separators; the whole match is group 0.
    found = F.regexp_extract_all(body, F.lit(ANY), F.lit(0))
    rewritten = docs.drop(*[c for c in docs.columns if c.lower() in {f"n_{k}" for k in KINDS} and c != text]).withColumn(
        "_new", F.when(body.rlike("[0-9@]") & body.rlike(ANY), F.transform(found, lambda v: pseudonym(v, secret, inverse)))
    )
    new = F.col("_new")
    whole = F.when(new.isNull(), body).otherwise(F.array_join(F.transform(
        F.split(body, ANY, -1), lambda p, i: F.concat(p, F.coalesce(F.get(new, i)["text"], F.lit("")))), ""))
    count = lambda kind: F.size(F.filter(new, lambda v: v["kind"] == kind)).cast("long")
    counts = {f"n_{kind}": count(kind) for kind in KINDS}
    return rewritten.withColumns({text: whole, **{k: F.when(new.isNull(), F.lit(0).cast("long")).otherwise(v) for k, v in counts.items()}}).drop("_new")
