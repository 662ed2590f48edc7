"""Personal numbers and dates replaced by keyed pseudonyms of the same format."""

from pyspark.sql import functions as F

EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}"
# The length of an IBAN by country, from the public ISO 13616 registry.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 "
    "FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
    "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 "
    "RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()


def _iban_pattern():
    """IBANs of their country's length, so that what follows one is not taken in; then any length for other countries."""
    lengths = sorted({int(c[2:]) for c in IBAN_LENGTHS})
    exact = [
        f"(?:{'|'.join(c[:2] for c in IBAN_LENGTHS if int(c[2:]) == n)})\\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n in lengths]
    return rf"(?<!\w)(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join(exact)}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{11,30}})(?!\w)"


IBAN = _iban_pattern()
DATE = r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\w|[.-]\d)"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_CARD_SHAPE = r"(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w|-\d)"
#: The usual groups first; other groups only where no usual ones begin a few groups later.
CARD = rf"(?<![\w-])(?:{_CARD_SHAPE}|(?!(?:\d{{1,19}}[ -]){{1,4}}{_CARD_SHAPE})\d(?:[ -]?\d){{12,18}}(?!\w|-\d))"
PHONE = r"(?<![\w+(-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-\d)"
#: Looked for in this order at every place.
PATTERN = "|".join([EMAIL, IBAN, DATE, IPV4, SSN, CARD, PHONE])
ROUNDS = 8
#: 400 years of days from 1800-01-01, and its factors for the Feistel halves.
DAYS, DAY_HALVES = 146_097, (189, 773)


def _let(value, body):
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _matches(pattern, x):
    return x.rlike(f"^(?:{pattern})$")


def _digits(x):
    return F.regexp_replace(x, r"\D", "")


def _chars(x):
    return F.split(x, "")


def feistel_text(x, key, tweak):
    """A keyed permutation of all strings of x's format: digits stay digits, letters letters of their case.

    Each round shifts the characters of one half, each within its class, by a
    keyed hash of the other half; every round can be undone, so equal values and only those meet.
    """
    half = (F.char_length(x) / 2).cast("int")
    start = F.struct(F.substring(x, F.lit(1), half).alias("a"), F.substring(x, half + 1, F.char_length(x)).alias("b"))

    def shifted(a, b, i):
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), b), 256)

        def turn(c, j):
            by = F.conv(F.substring(stream, (j % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            within = lambda low, n: F.chr(low + (code - low + by) % n)
            return (
                F.when(c.rlike("[0-9]"), within(48, 10)).when(c.rlike("[a-z]"), within(97, 26))
                .when(c.rlike("[A-Z]"), within(65, 26)).otherwise(c))

        return F.when(F.char_length(a) == 0, "").otherwise(F.array_join(F.transform(_chars(a), turn), ""))

    def step(acc, i):
        return F.struct(acc.b.alias("a"), shifted(acc.a, acc.b, i).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc.a, acc.b))


def feistel_number(x, sizes, key, tweak):
    """A keyed permutation of 0 .. a * b - 1: the parts of x = l * b + r are shifted in turn."""
    a, b = (F.lit(n).cast("long") for n in sizes)
    hashed = lambda side, i: F.conv(F.substring(F.sha2(
        F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), side.cast("string")), 256), 1, 12), 16, 10).cast("long")

    def step(acc, i):
        left = (acc.l + hashed(acc.r, i)) % a
        return _let(left, lambda l: F.struct(l.alias("l"), ((acc.r + hashed(l, i + 100)) % b).alias("r")))

    start = _let(x.cast("long"), lambda v: F.struct(F.floor(v / b).cast("long").alias("l"), (v % b).alias("r")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: acc.l * b + acc.r)


def _refill(token, digits):
    """``token`` with its digits replaced, one by one, by ``digits``."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(acc, c):
        digit = c.rlike("[0-9]")
        return F.struct(
            (acc.i + digit.cast("int")).alias("i"),
            F.concat(acc.out, F.when(digit, F.substring(digits, acc.i + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(_chars(token), start, step, lambda acc: acc.out)


def _luhn_sum(digits):
    """Luhn sum of digits that stand before a check digit."""
    def value(c, i):
        d = c.cast("int") * F.when((F.char_length(digits) - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), value), F.lit(0), lambda s, x: s + x)


def _luhn_digit(digits):
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def _mod97(text):
    """Remainder of the number that letters (A = 10 .. Z = 35) and digits spell."""
    def step(acc, c):
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


def _iban(x, key):
    def redone(plain):
        rest = F.substring(plain, F.lit(5), F.char_length(plain))
        return _let(feistel_text(rest, key, "iban"), lambda r: F.concat(
            F.substring(plain, 1, 2),
            F.lpad((98 - _mod97(F.concat(r, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0"), r))

    def spaced(chars):
        start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
        return F.aggregate(_chars(x), start, lambda acc, c: F.when(
            c == " ", F.struct(acc.i.alias("i"), F.concat(acc.out, c).alias("out"))).otherwise(F.struct(
                (acc.i + 1).alias("i"), F.concat(acc.out, F.substring(chars, acc.i + 1, F.lit(1))).alias("out"))),
            lambda acc: acc.out)

    plain = F.replace(x, F.lit(" "), F.lit(""))
    return _let(plain, lambda p: F.when(
        _mod97(F.concat(F.substring(p, F.lit(5), F.char_length(p)), F.substring(p, 1, 4))) == 1,
        _let(redone(p), spaced)))


def _day(x):
    """The date of a text in one of the four formats; NULL if there is no such day."""
    part = lambda pattern, group: F.regexp_extract(x, pattern, group)
    iso, dots, slashes = r"^(\d{4})[-/](\d{2})[-/](\d{2})$", r"^(\d{2})\.(\d{2})\.(\d{4})$", r"^(\d{2})/(\d{2})/(\d{4})$"
    text = (
        F.when(x.rlike(iso), F.concat_ws("-", part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(x.rlike(dots), F.concat_ws("-", part(dots, 3), part(dots, 2), part(dots, 1)))
        .otherwise(F.concat_ws("-", part(slashes, 3), part(slashes, 1), part(slashes, 2))))
    return F.try_to_date(text, "yyyy-MM-dd")


def _date(x, key):
    first = F.lit("1800-01-01").cast("date")

    def moved(n):
        new = F.date_add(first, feistel_number(n, DAY_HALVES, key, "date").cast("int"))
        out = lambda f: F.date_format(new, f)
        return (
            F.when(x.contains("-"), out("yyyy-MM-dd")).when(x.contains("."), out("dd.MM.yyyy"))
            .when(x.rlike(r"^\d{4}/"), out("yyyy/MM/dd")).otherwise(out("MM/dd/yyyy")))

    return _let(F.datediff(_day(x), first), lambda n: F.when((n >= 0) & (n < DAYS), moved(n)))


def _ipv4(x, key):
    octets = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    number = lambda o: F.aggregate(o, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    text = lambda n: F.concat_ws(".", *[F.shiftrightunsigned(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    return _let(octets, lambda o: F.when(
        ~F.exists(o, lambda p: p > 255), _let(feistel_number(number(o), (65_536, 65_536), key, "ipv4"), text)))


def _ssn(x, key):
    """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999, numbered without holes."""
    def moved(d):
        area, group, serial = (F.substring(d, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        index = ((area - 1 - (area > 666).cast("int")) * 99 + group - 1) * 9999 + serial - 1

        def text(n):
            left = F.floor(n / (99 * 9999))
            three = left + 1 + (left >= 665).cast("int")
            two = F.floor(n / 9999) % 99 + 1
            pad = lambda v, w: F.lpad(v.cast("string"), w, "0")
            return F.concat_ws("-", pad(three, 3), pad(two, 2), pad(n % 9999 + 1, 4))

        return F.when(valid, _let(feistel_number(index, (898 * 99, 9999), key, "ssn"), text))

    return _let(_digits(x), moved)


def _card(x, key):
    """Luhn-valid numbers; the first digit stays, the check digit is made anew."""
    def moved(d):
        n = F.char_length(d)
        body, check = F.substring(d, F.lit(1), n - 1), F.substring(d, n, F.lit(1))
        fresh = F.concat(F.substring(d, 1, 1), feistel_text(F.substring(d, F.lit(2), n - 2), key, "card"))
        valid = (n >= 13) & (n <= 19) & (_luhn_digit(body) == check) & ~d.rlike("^(.)\\1*$")
        return F.when(valid, _let(fresh, lambda f: _refill(x, F.concat(f, _luhn_digit(f)))))

    return _let(_digits(x), moved)


def _phone(x, key):
    """The country code and the first digits of area and exchange stay, whatever they are.

    Without a country code an area code that begins with 1 is none.
    """
    def moved(d):
        local = F.substring(d, F.char_length(d) - 9, F.lit(10))
        part = lambda a, n: F.substring(local, a, n)
        fresh = feistel_text(F.concat(part(2, 2), part(5, 6)), key, "phone")
        whole = lambda f: F.concat(
            F.substring(d, F.lit(1), F.char_length(d) - 10), part(1, 1), F.substring(f, 1, 2), part(4, 1), F.substring(f, 3, 6))
        valid = (F.char_length(d) > 10) | (part(1, 1) != "1")
        return F.when(valid, _let(fresh, lambda f: _refill(x, whole(f))))

    return _let(_digits(x), moved)


def _email(x, key):
    local = F.substring_index(x, "@", 1)
    return F.concat(feistel_text(local, key, "email"), F.substring(x, F.char_length(local) + 1, F.char_length(x)))


KINDS = [
    ("email", EMAIL, _email), ("iban", IBAN, _iban), ("date", DATE, _date), ("ipv4", IPV4, _ipv4),
    ("ssn", SSN, _ssn), ("card", CARD, _card), ("phone", PHONE, _phone),
]


def _found(token, key):
    """(kind, token, pseudonym) of a match; kind and pseudonym are NULL if it is not valid."""
    kind = F.lit(None).cast("string")
    new = F.lit(None).cast("string")
    named = {"phone": F.when(_digits(token).rlike("[2-9]..[2-9].{6}$"), "phone").otherwise("phone_other")}
    bare = {"email": "@", "iban": "^[A-Z]", "date": rf"^(?:{DATE})$", "ipv4": rf"^(?:{IPV4})$", "ssn": rf"^(?:{SSN})$"}
    for name, pattern, make in reversed(KINDS):
        here = F.lit(True) if name == "phone" else token.rlike(bare.get(name, f"^(?:{pattern})$"))
        kind, new = F.when(here, named.get(name, F.lit(name))).otherwise(kind), F.when(here, make(token, key)).otherwise(new)
    return _let(new, lambda n: F.struct(F.when(n.isNotNull(), kind).alias("kind"), token.alias("value"), n.alias("pseudonym")))


def pseudonymise(docs, key, text_col="text", found_col="pseudonyms"):
    """``docs`` with every valid personal value replaced, and an array column of what was replaced.

    Looked for: e-mail addresses, IBANs (mod 97, of their country's length), days (four formats, 1800 to 2199), IPv4
    addresses, US social security numbers, payment cards (Luhn; other digits or capitals may stand beside
    cards and IBANs) and
    ten-digit phone numbers (kind ``phone_other`` if the area code or the exchange begins
    with 0 or 1). Values that fail their check stay as they are, and so do
    numbers without a country code whose area code begins with 1. A value is
    permuted by a keyed Feistel network within its own format, so the result is
    valid again and equal values get equal pseudonyms in all documents, also
    if they are punctuated in another way. ``found_col`` holds (kind, pseudonym) in order
    of place. NULL and empty texts have none and stay. Repeated rows and rows
    without an id are treated like any other; a clashing ``found_col`` is replaced.

    JVM expressions only, in one pass without a shuffle; rows without a match
    cost one scan of their text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    tokens = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    values = F.when(text.rlike(PATTERN), F.transform(tokens, lambda t: _found(t, key))).otherwise(none)
    marked = docs.withColumn("__values", values)
    rebuilt = F.array_join(F.zip_with(
        F.split(text, PATTERN, -1), "__values",
        lambda gap, v: F.concat(gap, F.coalesce(v.pseudonym, v.value, F.lit("")))), "")
    hits = F.filter("__values", lambda v: v.pseudonym.isNotNull())
    return marked.withColumns({
        text_col: F.when(F.size(hits) > 0, rebuilt).otherwise(F.col(text_col).cast("string")),
        found_col: F.transform(hits, lambda v: F.struct(v.kind.alias("kind"), v.pseudonym.alias("pseudonym"))),
    }).drop("__values")
