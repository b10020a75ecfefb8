"""Format-preserving pseudonyms: DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 10
_B, _A = r"(?<![\p{L}\p{N}_])(?<!\d[.,:/-])", r"(?![\p{L}\p{N}_])(?![.,:/-]?\d)"
#: Characters of an IBAN by country.
_IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "|".join(" ".join(_IBANS.values()).split())
_BY_COUNTRY = "|".join(rf"(?:{x.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, x in _IBANS.items())
_CARD = r"\d{4}(?<%s>[ -])(?:\d{4}\k<%s>\d{4}\k<%s>\d{4}|\d{6}\k<%s>\d{4,5})"
_DIGIT = r"[ .()-]{0,2}\d"
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}" + _A + r"(?<=\+" + 8 * _DIGIT + 7 * f"(?:{_DIGIT}" + 7 * ")?" + ")"
#: Country calling codes, no one the start of another.
_CODES = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[789]|8[0578]|9[679])\d)"
_MAIL = r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_+-][\p{L}\p{N}_.+-]{0,63}+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
#: What may be personal but mail: IBAN, dates, social security number, card, address, phone. Validity is judged afterwards.
#: An IBAN ends where its country's does; a phone has ten digits after the code 1, else 8 to 15 in all, as many as it can,
#: but leaves a card after it whole.
#: No value starts with another character than those looked for first, which keeps prose cheap.
_NUMBERS = r"(?=[0-9A-Z+(])(?:" + "|".join((
    _B + rf"(?=[A-Z]{{2}}\d{{2}})(?:{_BY_COUNTRY})" + _A,
    _B + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _A,
    _B + r"\d{4}-\d{2}-\d{2}" + _A,
    _B + r"\d{2}[./]\d{2}[./]\d{4}" + _A,
    _B + r"\d{3}-\d{2}-\d{4}" + _A,
    _B + _CARD.replace("%s", "gap") + _A,
    _B + r"(?:(?<!\+(?:\d{1,2}[ .-]?)?)\d{13}|(?<!\+(?:\d[ .-]?)?)\d{14}|(?<!\+)\d{15}|\d{16,19})" + _A,
    r"(?<![\p{L}\p{N}_.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}_])(?!\.\d)",
    r"(?<![\p{L}\p{N}_+])\+1(?:[ .()-]{0,2}\d){10}" + _A,
    r"(?<![\p{L}\p{N}_+])(?!\+1)" + _PHONE + r"(?=[ ,;/]+(?:" + _CARD.replace("%s", "after") + r"|\d{13,19})" + _A + ")",
    r"(?<![\p{L}\p{N}_+])(?!\+1)" + _PHONE,
    r"(?<!(?<![\p{L}\p{N}_+])\+\d{1,3}[ .-]?)" + _B + r"(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}" + _A,
)) + ")"
PATTERN = f"{_MAIL}|{_NUMBERS}"
#: Days of a whole cycle of the calendar, 1800-01-01 to 2199-12-31: 146097 = 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Marks around a find, put before its place in the text; and what stands for them, and for itself, where a text has them.
_OPEN, _CLOSE, _ESCAPE = "\ufdd0", "\ufdd1", "\ufdd2"
_HIDDEN = ((_ESCAPE, _ESCAPE + "\ufdd3"), (_OPEN, _ESCAPE + "\ufdd4"), (_CLOSE, _ESCAPE + "\ufdd5"))
#: Finds of a part, whose texts are joined before the next part.
PART = 200


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tweak: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs with 0 <= l < a, 0 <= r < b (longs up to 10^15). Rounds add a hash of
    one half to the other in turn, so every round can be undone and no two values meet."""

    def add(to: Column, half: Column, i: Column, size: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        return F.pmod(to + F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"), size)

    def round_(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, add(s["l"], s["r"], i, a)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(add(s["r"], s["l"], i, b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), round_)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted(digits: Column, key: str, tweak: str) -> Column:
    """Digits of up to 30 places, permuted among all digits of that length."""

    def made(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        left, right = F.substr(d, F.lit(1), half), F.substr(d, half + 1)
        size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        mixed = feistel(F.when(half == 0, F.lit("0")).otherwise(left).cast("long"), right.cast("long"), size(half), size(n - half), key, F.concat(F.lit(tweak), n.cast("string")))
        return let(mixed, lambda out: F.concat(F.when(half == 0, F.lit("")).otherwise(F.lpad(out["l"].cast("string"), half, "0")), F.lpad(out["r"].cast("string"), n - half, "0")))

    return let(digits, made)


def _written(like: Column, digits: Column) -> Column:
    """`digits` in the places of the digits of `like`; all else stays."""

    def step(s: Column, c: Column, d: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["text"], F.when(is_digit, F.substr(d, s["at"], F.lit(1))).otherwise(c)).alias("text"), (s["at"] + is_digit.cast("int")).alias("at"))

    return let(digits, lambda d: F.aggregate(F.split(like, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), lambda s, c: step(s, c, d), lambda s: s["text"]))


def _luhn_sum(digits: Column) -> Column:
    """Of digits whose last one is not doubled."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda s, x: s + x)


def _mod97(iban: Column) -> Column:
    """Of an IBAN without blanks, its first four characters moved to the end and letters read as 10 .. 35."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: value(F.substr(moved, i, F.lit(1)))), F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        body = _permuted(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(_luhn_sum(d) % 10 == 0, _written(m, whole)).otherwise(m)

    return let(_digits(m), made)


def _iban(m: Column, key: str) -> Column:
    def made(flat: Column) -> Column:
        rest = F.substr(flat, F.lit(5))

        def checked(new: Column) -> Column:
            body = F.concat(F.substr(flat, F.lit(1), F.lit(2)), F.lit("00"), _written(rest, new))
            return F.concat(F.lpad((98 - _mod97(body)).cast("string"), 2, "0"), new)

        whole = let(_permuted(_digits(rest), key, "iban"), checked)
        return F.when((_mod97(flat) == 1) & (F.length(_digits(rest)) > 0) & (F.length(flat) <= 34), _written(m, whole)).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), made)


def _shortened(m: Column) -> Column:
    """A find whose country is not listed, cut before the words that keep it from being an IBAN, if any do."""
    words = F.split(m, " ")
    cut = F.transform(F.sequence(F.size(words) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
    flat = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    first = F.get(F.filter(cut, lambda x: (F.length(flat(x)) >= min(_IBANS)) & (_mod97(flat(x)) == 1)), F.lit(0))
    unlisted = m.rlike(rf"^(?!{_LISTED})[A-Z]{{2}}\d\d[A-Z0-9 ]+ [A-Z0-9 ]+$")
    return F.when(unlisted, F.when(_mod97(flat(m)) == 1, m).otherwise(F.coalesce(first, m))).otherwise(m)


def _address(m: Column, key: str) -> Column:
    octet = lambda i: F.split(m, r"\.")[i].cast("int")
    good = reduce(lambda x, y: x & y, ((octet(i) <= 255) & (octet(i).cast("string") == F.split(m, r"\.")[i]) for i in range(4)))
    size = F.lit(65536).cast("long")
    mixed = feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), size, size, key, F.lit("ip"))
    parts = lambda out: (F.floor(out["l"] / 256), out["l"] % 256, F.floor(out["r"] / 256), out["r"] % 256)
    return F.when(good, let(mixed, lambda out: F.concat_ws(".", *(p.cast("string") for p in parts(out))))).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Year first; else day first with points, and month first (day first, if that is no date) with slashes."""
    forms = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")
    read = lambda form: F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))
    found = lambda day, form: F.struct(day.alias("day"), F.lit(form).alias("form"))
    slashed = let(read(forms[2]), lambda day: F.when(day.isNotNull(), found(day, 2)).otherwise(found(read(forms[3]), 3)))
    which = F.when(m.contains("-"), found(read(forms[0]), 0)).when(m.contains("."), found(read(forms[1]), 1)).otherwise(slashed)

    def moved(s: Column) -> Column:
        size = [F.lit(n).cast("long") for n in DAYS]
        mixed = feistel(F.floor(s["day"] / DAYS[1]), s["day"] % DAYS[1], *size, key, F.lit("date"))
        new = let(mixed, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")))
        written = let(new, lambda d: F.coalesce(*(F.when(s["form"] == k, F.date_format(d, form)) for k, form in enumerate(forms))))
        return F.when(s["day"].between(0, DAYS[0] * DAYS[1] - 1), written).otherwise(m)

    return let(which, moved)


def _ssn(m: Column, key: str) -> Column:
    """Areas 1 .. 899 but 666, groups 1 .. 99, serials 1 .. 9999, onto the same."""
    area, group, serial = F.substr(m, F.lit(1), F.lit(3)).cast("int"), F.substr(m, F.lit(5), F.lit(2)).cast("int"), F.substr(m, F.lit(8), F.lit(4)).cast("int")
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    mixed = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, F.lit("ssn"))
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    written = lambda out: F.concat_ws("-", pad(out["l"] + F.when(out["l"] >= 665, 2).otherwise(1), 3), pad(F.floor(out["r"] / 9999) + 1, 2), pad(out["r"] % 9999 + 1, 4))
    return F.when(good, let(mixed, written)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """With a plus: a listed country's code, which stays, and 8 to 15 digits in all, after the code 1 ten. Without one: ten
    digits. The digits' places stay."""

    def made(d: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(d, "^" + _CODES, 0)).otherwise("")
        good = F.when(~m.startswith("+"), F.length(d) == 10).otherwise((code != "") & F.length(d).between(8, 15) & ((code != "1") | (F.length(d) == 11)))
        return F.when(good, _written(m, let(code, lambda c: F.concat(c, _permuted(F.substr(d, F.length(c) + 1), key, "phone"))))).otherwise(m)

    return let(_digits(m), made)


_ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"


def _letters(chars: Column, key: str, tweak: Column) -> Column:
    """An array of up to 64 characters of _ALPHABET, permuted among all arrays of its length: the Feistel rounds add the bytes of
    a hash of one half to the places of the other."""

    def add(to: Column, half: Column, i: Column) -> Column:
        hashed = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), F.array_join(half, "")), 256)
        byte = lambda h, k: F.conv(F.substr(h, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
        return let(hashed, lambda h: F.transform(to, lambda c, k: F.substr(F.lit(_ALPHABET), F.pmod(F.instr(F.lit(_ALPHABET), c) - 1 + byte(h, k), F.lit(36)) + 1, F.lit(1))))

    def round_(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, add(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(add(s["r"], s["l"], i)).alias("r"))

    half = F.floor(F.size(chars) / 2).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, F.size(chars)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, round_, lambda s: F.concat(s["l"], s["r"]))


def _mail(m: Column, key: str) -> Column:
    """The domain stays; the letters a to z (without case) and digits of the local part are permuted, all else in it stays.
    Addresses that differ in more than case never meet; a local part without either becomes 16 letters of a keyed hash."""
    local, domain = F.lower(F.substring_index(m, "@", 1)), F.substring_index(m, "@", -1)

    def made(chars: Column) -> Column:
        own = F.filter(chars, lambda c: F.instr(F.lit(_ALPHABET), c) > 0)

        def step(s: Column, c: Column, new: Column) -> Column:
            moves = F.instr(F.lit(_ALPHABET), c) > 0
            return F.struct(F.concat(s["text"], F.when(moves, F.get(new, s["at"])).otherwise(c)).alias("text"), (s["at"] + moves.cast("int")).alias("at"))

        written = lambda new: F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), lambda s, c: step(s, c, new), lambda s: s["text"])
        hashed = F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), local), 256), 1, 16), "0123456789", "ghijklmnop")
        shape = F.concat(F.lit("mail"), F.size(own).cast("string"), F.lower(domain))
        return F.when(F.size(own) > 0, let(_letters(own, key, shape), written)).otherwise(hashed)

    return F.concat(let(F.split(local, ""), made), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """Of one find of PATTERN; the find itself where it is not valid."""
    return (
        F.when(m.contains("@"), _mail(m, key))
        .when(m.rlike(r"^[A-Z]{2}"), _iban(m, key))
        .when(m.rlike(r"^(\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4})$"), _date(m, key))
        .when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), _ssn(m, key))
        .when(m.rlike(rf"^(\d{{13,19}}|{_CARD.replace('%s', 'gap')})$"), _card(m, key))
        .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"), _address(m, key))
        .otherwise(_phone(m, key))
    )


def pseudonymized(docs: DataFrame, key: str, count: str = "n_pseudonyms") -> DataFrame:
    """`docs` with every valid mail address, IBAN, date, social security number, card, IPv4 address and phone number in
    `text` replaced by its pseudonym under `key`, which is a secret, and with a column that counts them. Finds that fail
    their check (Luhn, mod 97, calendar, octets, ranges, country and length) stay, as does all other text to the
    character; a value that starts in such a find is tried in its turn.

    Equal values have equal pseudonyms in every document, and unequal values of a kind never meet, as all are permuted
    (mail without regard to case). A value may by chance be its own pseudonym. Null text stays null with no finds; texts
    of any length are read in one pass of a pattern. Rows and other columns stay as they are, but for one of the count's
    name, which is replaced. Row by row in the JVM: no shuffle, nothing to skew.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col("text").cast("string")
    old, new, rest, out = (unused(docs, name) for name in ("finds", "pseudonyms", "between", "replaced"))
    made = docs.withColumn(rest, F.when(text.rlike("[0-9@]"), F.split(_marked(text), _OPEN, -1)).otherwise(F.array().cast("array<string>")))
    found = lambda c: F.when(F.size(rest) > 1, c)
    finds = F.transform(F.slice(rest, F.lit(2), F.size(rest)), lambda x: _shortened(_shown(F.substring_index(x, _CLOSE, 1))))
    made = made.withColumn(old, found(finds))
    made = made.withColumn(new, found(F.transform(old, lambda m: pseudonym(m, key))))
    made = made.withColumn(out, found(_replaced(F.col(old), F.col(new), F.transform(rest, lambda x: _shown(F.substring_index(x, _CLOSE, -1))))))
    made = made.withColumns({"text": F.when(F.size(rest) > 1, F.col(out)["text"]).otherwise(text), count: F.when(F.size(rest) > 1, F.col(out)["n"]).otherwise(0)})
    return made.drop(old, new, rest, out)


def _marked(text: Column) -> Column:
    """The text with every find between marks put in before the place where it starts; finds may start in finds."""
    marks = F.lit(f"{_OPEN}$1{_CLOSE}")
    for plain, hidden in _HIDDEN:
        text = F.when(text.contains(plain), F.replace(text, F.lit(plain), F.lit(hidden))).otherwise(text)
    return F.when(text.contains("@"), F.regexp_replace(text, F.lit(f"(?=({PATTERN}))"), marks)).otherwise(F.regexp_replace(text, F.lit(f"(?=({_NUMBERS}))"), marks))


def _shown(text: Column) -> Column:
    for plain, hidden in reversed(_HIDDEN):
        text = F.when(text.contains(hidden), F.replace(text, F.lit(hidden), F.lit(plain))).otherwise(text)
    return text


def _replaced(finds: Column, new: Column, between: Column) -> Column:
    """struct(text, n): from the left, valid finds by their pseudonyms; those that start in a replaced find are its text.
    `between`: the text before the first find, then the texts from each find's start up to the next start."""
    state = lambda over, n, texts: F.struct(over.cast("int").alias("over"), n.cast("int").alias("n"), texts.alias("texts"))
    none = F.array().cast("array<string>")

    def step(s: Column, i: Column, parts: Column) -> Column:
        """`over`: characters from here on that are replaced already."""
        find, text = F.get(finds, i), F.get(parts, i + 1)
        hit = (s["over"] == 0) & (F.get(new, i) != find)
        over = F.when(hit, F.length(find)).otherwise(s["over"])
        piece = F.concat(F.when(hit, F.get(new, i)).otherwise(""), F.substr(text, over + 1))
        return state(F.greatest(over - F.length(text), F.lit(0)), s["n"] + hit.cast("int"), F.concat(s["texts"], F.array(piece)))

    def part(s: Column, k: Column, parts: Column) -> Column:
        places = F.sequence(k * PART, F.least(k * PART + PART, F.size(finds)) - 1)
        return F.aggregate(places, state(s["over"], s["n"], none), lambda s, i: step(s, i, parts), lambda e: state(e["over"], e["n"], F.concat(s["texts"], F.array(F.array_join(e["texts"], "")))))

    def whole(parts: Column) -> Column:
        ks = F.sequence(F.lit(0), F.floor((F.size(finds) - 1) / PART).cast("int"))
        return F.aggregate(ks, state(F.lit(0), F.lit(0), F.concat(none, F.slice(parts, F.lit(1), F.lit(1)))), lambda s, k: part(s, k, parts), lambda e: F.struct(F.array_join(e["texts"], "").alias("text"), e["n"].alias("n")))

    return let(between, whole)
