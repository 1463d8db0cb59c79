"""Format-preserving pseudonyms for personal data.

Matches of one pattern are validated by kind and replaced by a keyed Feistel permutation within their format, so that one
value has one pseudonym in every document and different values have different ones:
card numbers (Luhn), also beside other numbers: any window of 13 to 19 digits at the edges of digit groups - the digits
before the check digit are permuted and it is made anew; North American phone numbers - area, exchange and line, where valid
areas and exchanges (no leading 0 or 1) stay valid; international ones (8 to 15 digits, by E.164) - the digits after the
country code; IBANs (mod 97) - letters and digits after the country, and new check digits; dates - the day within its
400-year cycle; IPv4 addresses - the 32 bits; IPv6 addresses as they are written - their hex digits; social security
numbers - among the valid ones; e-mail addresses - letters and digits of the local part and of all domain labels but the
last; secrets after words like token or password - letters and digits of the value (as hex, if it is hex). What doesn't
validate stays as it is.

The key decides the permutations, and who has it can invert them: it is an argument without a default.

Only DataFrame functions, no shuffle: one projection over the texts. Texts that hold no digit, no @ and no named secret are
passed through unread by the pattern, which is linear in the text: it is anchored by look-behinds and possessive, so that long runs don't backtrack.

A null text stays null, an empty one empty; every row gives one row; other columns pass through, but n_pii is replaced and
n_chars, if there, follows the new text (names that begin with __pii_ are the operator's own). An empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# The forms that are looked for.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
SECRET = r"(?i:(?<![a-z])(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)(?:\"|')?\s{0,3}[=:]\s{0,3}(?:\"|')?)[A-Za-z0-9+/_~.-]{8,}+"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
ABROAD = rf"(?<![\d+])\+[1-9]\d{{0,2}}(?:[ .-]?\(\d{{1,4}}\)|[ .-]\d{{1,5}})(?:[ .-]?(?!{DATE}|{IP}|{SSN})\d{{2,8}}){{1,5}}+(?!\d)|(?<![\d+])\+[1-9]\d{{7,14}}(?!\d)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])"
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\w:.])(?:(?:{_H}:){{7}}{_H}|{_H}(?::{_H}){{0,5}}+::(?:{_H}(?::{_H}){{0,5}})?+)(?![\w:])"
# a group of digits that doesn't go on a run: another kind starts there and has signs that runs don't have
OTHER = rf"{EMAIL}|{IP}|{IPV6}|(?<![\d/-])\d{{2}}/\d{{2}}/\d{{4}}(?![\d/-])|(?=\d{{3}}(?:[ -]\d{{3}})?\.){PHONE}"
CARD = rf"(?<!\d)(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{OTHER})\d++)*+"  # a run of groups that may hold cards
WITHIN = f"(?!^)(?:{DATE}|{SSN}|{PHONE})"  # beside the cards of a run; at its start they were looked for before
ANY = "|".join((EMAIL, SECRET, IP, IPV6, IBAN, DATE, SSN, PHONE, ABROAD, CARD))
# Country codes of one and two digits; all others have three.
SHORT_CODES = "1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
MAY = f"[0-9@]|{SECRET}"  # every match of ANY has one of these


def _bits(*parts: Column) -> Column:
    """60 keyed bits of a round as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, mod_a: Column | int, mod_b: Column | int, key: str, tag: Column) -> tuple[Column, Column]:
    """Permutes pairs (a below mod_a, b below mod_b): an even number of rounds, each adding a keyed hash of one half."""
    ma, mb = (m if isinstance(m, Column) else F.lit(m).cast("long") for m in (mod_a, mod_b))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda acc, i: F.struct(acc["b"].alias("a"), ((acc["a"] + _bits(F.lit(key), tag, i, acc["b"]) % F.when(i % 2 == 0, ma).otherwise(mb)) % F.when(i % 2 == 0, ma).otherwise(mb)).alias("b"))
    done = F.aggregate(rounds, start, step)
    return done["a"], done["b"]


def permute_digits(digits: Column, key: str, tag: Column) -> Column:
    """Digits (2 to 36 of them) to as many digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), (k + 1).cast("int"), F.lit("0")).cast("long")
    a, b = F.substr(digits, F.lit(1), u), F.substr(digits, u + 1, n - u)
    x = F.array(F.struct(*[c.alias(k) for c, k in zip(feistel(a, b, power(u), power(n - u), key, F.concat_ws("|", tag, n)), ("a", "b"), strict=True)]))
    return F.element_at(F.transform(x, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), n - u, "0"))), 1)


def refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct((acc["at"] + 1).alias("at"), F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"))).otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["out"], c).alias("out")))
    return F.aggregate(F.split(template, ""), start, step, lambda acc: acc["out"])


def luhn_sum(digits: Column) -> Column:
    """Sum of digits from the right, every second doubled, the last one counting once."""
    n = F.length(digits)
    value = lambda c, i: c.cast("int") * F.when((n - 1 - i) % 2 == 1, 2).otherwise(1)
    parts = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: value(c, i) - F.when(value(c, i) > 9, 9).otherwise(0))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    move = lambda d: permute_digits(d, key, F.lit("card"))
    # a card of zeros isn't valid; the walk goes on from it to the next number of the cycle
    body = _bound(move(F.substr(digits, F.lit(1), F.length(digits) - 1)), lambda d: F.when(d.rlike("[1-9]"), d).otherwise(move(d)))
    check = lambda d: F.concat(d, ((10 - luhn_sum(F.concat(d, F.lit("0"))) % 10) % 10).cast("string"))
    return _bound(body, lambda d: refill(m, check(d)))


def _counted(m: Column, new: Column) -> Column:
    """A struct of the new text of a match and how many values it replaces: one if they differ."""
    return _bound(new, lambda d: F.struct(d.alias("text"), (d != m).cast("int").alias("n")))


def _joined(text: Column, pattern: str, new: Column) -> Column:
    """The text with the matches of the pattern replaced by those of new (structs of text and n), and the sum of n."""
    parts = F.zip_with(F.split(text, pattern, -1), new, lambda g, x: F.concat(g, F.coalesce(x["text"], F.lit(""))))
    return F.struct(F.array_join(parts, "").alias("text"), F.aggregate(new, F.lit(0), lambda a, x: a + x["n"]).alias("n"))


def _windows(groups: Column, i: Column) -> Column:
    """The best card that begins with group i, a struct of rank and last group, or null. Rank 0: one group; 1: groups of 4,
    or 4, 6 and 4 or 5; 2: any others, more digits first."""
    upto = F.sequence(i, F.least(i + 18, F.size(groups) - 1))
    each = F.transform(upto, lambda j: F.struct(j.alias("j"), F.array_join(F.slice(groups, i + 1, j - i + 1), "").alias("w")))
    sized = F.filter(F.transform(each, lambda x: F.struct(x["j"].alias("j"), x["w"].alias("w"), F.regexp_replace(x["w"], "[ -]", "").alias("d"))), lambda x: x["d"].rlike("^[0-9]{13,19}$"))
    valid = F.filter(sized, lambda x: (luhn_sum(x["d"]) % 10 == 0) & x["d"].rlike("[1-9]"))
    usual = lambda x: x["w"].rlike(r"^(?:\d{4}[ -]){3}\d{4}[ -]?$|^\d{4}[ -]\d{6}[ -]\d{4,5}[ -]?$")
    rank = lambda x: F.when(x["j"] == i, 0).when(usual(x), 1).otherwise(2)
    return F.array_min(F.transform(valid, lambda x: F.struct(rank(x).alias("rank"), (-x["j"]).alias("back"), x["j"].alias("j"))))


def _run(m: Column, key: str) -> Column:
    """The cards of a run of digit groups, from left to right: every Luhn-valid window of 13 to 19 digits at the edges of
    groups that overlaps none of a better rank; then what else is between them."""

    def marked(groups: Column, best: Column) -> Column:
        def step(acc, i):
            own = F.element_at(best, i + 1)
            better = F.exists(F.slice(best, i + 2, F.greatest(own["j"] - i, F.lit(0))), lambda o: o["rank"] < own["rank"])
            taken = own.isNotNull() & ~F.coalesce(better, F.lit(False))
            window = F.array_join(F.slice(groups, i + 1, own["j"] - i + 1), "")
            # marks around the card, the sign after it outside
            card = F.regexp_replace(window, "^(.*[0-9])([ -]?)$", "\x01$1\x02$2")
            return F.when(i < acc["free"], acc).when(taken, F.struct((own["j"] + 1).alias("free"), F.concat(acc["out"], card).alias("out"))).otherwise(F.struct((i + 1).alias("free"), F.concat(acc["out"], F.element_at(groups, i + 1)).alias("out")))

        start = F.struct(F.lit(0).alias("free"), F.lit("").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda acc: acc["out"])

    def piece(p):
        inner = F.regexp_replace(p, "[\x01\x02]", "")
        beside = _bound(F.transform(F.regexp_extract_all(p, F.lit(WITHIN), F.lit(0)), lambda x: _counted(x, _simple(x, key))), lambda new: _joined(p, WITHIN, new))
        return F.when(p.startswith("\x01"), _counted(inner, _card(inner, key))).otherwise(beside)

    text = _bound(F.split(m, "(?<=[ -])"), lambda g: _bound(F.transform(F.sequence(F.lit(0), F.size(g) - 1), lambda i: _windows(g, i)), lambda best: marked(g, best)))
    pieces = F.transform(F.filter(F.split(text, "(?=\x01)|(?<=\x02)"), lambda p: p != ""), piece)
    return _bound(pieces, lambda new: F.struct(F.array_join(F.transform(new, lambda x: x["text"]), "").alias("text"), F.aggregate(new, F.lit(0), lambda a, x: a + x["n"]).alias("n")))


def _phone(m: Column, key: str) -> Column:
    """The national number is the last ten digits; area and exchange stay with or without a leading 0 or 1."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    part = lambda d, at, n: F.substr(d, F.length(d) - 9 + at, F.lit(n)).cast("long")
    most = lambda x: F.when(x >= 200, F.lit(800)).otherwise(F.lit(200)).cast("long")
    low = lambda x: F.when(x >= 200, F.lit(200)).otherwise(F.lit(0)).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def moved(v: Column) -> Column:
        a, b = feistel((v["area"] - v["area0"]) * v["exchanges"] + v["exchange"] - v["exchange0"], v["line"], v["areas"] * v["exchanges"], 10_000, key, F.concat_ws("|", F.lit("phone"), v["areas"], v["exchanges"]))
        text = lambda x: F.concat(v["lead"], pad(v["area0"] + F.floor(x["a"] / v["exchanges"]).cast("long"), 3), pad(v["exchange0"] + x["a"] % v["exchanges"], 3), pad(x["b"], 4))
        return _bound(F.struct(a.alias("a"), b.alias("b")), lambda x: refill(m, text(x)))

    parts = lambda d: F.struct(F.substr(d, F.lit(1), F.length(d) - 10).alias("lead"), part(d, 0, 3).alias("area"), part(d, 3, 3).alias("exchange"), part(d, 6, 4).alias("line"))
    sized = lambda v: F.struct(v["lead"].alias("lead"), v["line"].alias("line"), *[x for c in ("area", "exchange") for x in (v[c].alias(c), low(v[c]).alias(f"{c}0"), most(v[c]).alias(f"{c}s"))])
    return _bound(digits, lambda d: _bound(parts(d), lambda v: _bound(sized(v), moved)))


def _abroad(m: Column, key: str) -> Column:
    """A number with a country code, which is what stands before the first sign or, in a plain run, what the list of codes
    says; null if it has too few or too many digits."""
    apart = F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1)

    def moved(digits: Column) -> Column:
        listed = F.regexp_extract(digits, f"^({SHORT_CODES})", 1)
        code = F.when(apart != "", apart).when(listed != "", listed).otherwise(F.left(digits, F.lit(3)))
        own = lambda c: F.substr(digits, F.length(c) + 1, F.length(digits) - F.length(c))
        new = _bound(code, lambda c: _bound(permute_digits(own(c), key, F.concat_ws("|", F.lit("abroad"), c)), lambda d: refill(m, F.concat(c, d))))
        return F.when(F.length(digits).between(8, 15), new)

    return _bound(F.regexp_replace(m, "[^0-9]", ""), moved)


def _mod97(text: Column) -> Column:
    """The number that digits and letters (A = 10 .. Z = 35) make, modulo 97."""
    value = lambda c: F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("int") - 1
    step = lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    """Null if the check digits don't fit."""
    sums = lambda country, own: F.lpad((98 - _mod97(F.concat(own, country, F.lit("00")))).cast("string"), 2, "0")
    spaced = lambda t: F.when(m.contains(" "), F.trim(F.regexp_replace(t, "(.{4})", "$1 "))).otherwise(t)

    def moved(plain: Column) -> Column:
        country, own = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5), F.length(plain) - 4)
        valid = F.length(plain).between(15, 34) & (_mod97(F.concat(own, F.left(plain, F.lit(4)))) == 1)
        return F.when(valid, _bound(permute_text(own, key, "iban"), lambda new: spaced(F.concat(country, sums(country, new), new))))

    return _bound(F.regexp_replace(m, " ", ""), moved)


def _ipv6(m: Column, key: str) -> Column:
    """Hex digits permuted in place; small and capital forms of one address are linked, a shortened form is its own value."""
    valid = m.rlike("[0-9]") & (F.size(F.split(F.regexp_replace(m, "::", ":"), ":")) >= 2) & ~m.rlike("::$")
    new = permute_text(F.lower(m), key, "ipv6", _HEX)
    return F.when(valid, F.when(m.rlike("[A-F]"), F.upper(new)).otherwise(new)).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999: pairs of (area and group, serial) are permuted."""
    valid = ~m.rlike(r"^(000|666|9\d\d)|-00-|-0000$")
    area, group, serial = (F.substr(m, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = (area - 1 - (area > 666).cast("long")) * 99 + group - 1
    a, b = feistel(place, serial - 1, 898 * 99, 9999, key, F.lit("ssn"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")

    def text(v: Column) -> Column:
        area = F.floor(v["a"] / 99).cast("long") + 1
        return F.concat_ws("-", pad(area + (area >= 666).cast("long"), 3), pad(v["a"] % 99 + 1, 2), pad(v["b"] + 1, 4))

    return F.when(valid, _bound(F.struct(a.alias("a"), b.alias("b")), text)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    o = lambda i: F.split(m, r"\.")[i].cast("long")
    valid = F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255)
    a, b = feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), 65536, 65536, key, F.lit("ip"))
    text = _bound(F.struct(a.alias("a"), b.alias("b")), lambda p: F.concat_ws(".", F.shiftright(p["a"], 8), p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256))
    return F.when(valid, text).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Days of a 400-year cycle are 27 * 5411; the cycle and the layout stay."""
    iso = m.rlike("^[0-9]{4}-")
    day = F.when(iso, m.try_cast("date")).otherwise(F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.substr(m, F.lit(1), F.lit(2))).try_cast("date"))
    us = F.concat_ws("-", F.substr(m, F.lit(7), F.lit(4)), F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(4), F.lit(2))).try_cast("date")
    found = F.coalesce(day, F.when(~iso, us))
    number = F.unix_date(found)
    base = F.unix_date(F.to_date(F.lit("1600-01-01")))
    cycle = F.floor((number - base) / 146097)
    index = number - base - cycle * 146097
    a, b = feistel(F.floor(index / 5411), index % 5411, 27, 5411, key, F.lit("date"))
    new = F.date_from_unix_date((base + cycle * 146097 + _bound(F.struct(a.alias("a"), b.alias("b")), lambda p: p["a"] * 5411 + p["b"])).cast("int"))
    out = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(day.isNotNull(), F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "MM/dd/yyyy"))
    return F.when(found.isNotNull(), out).otherwise(m)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = ("0123456789abcdef",)


def _shift(chars: Column, seed: Column, alphabets: tuple[str, ...]) -> Column:
    """Each sign moved within its alphabet by a keyed stream that depends on `seed` and its place."""
    stream = lambda i: F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 8), 16, 10).cast("long")

    def one(c, i):
        out = c
        for letters in alphabets:
            place = F.position(c, F.lit(letters))
            out = F.when(place > 0, F.substr(F.lit(letters), ((place - 1 + stream(i)) % len(letters)).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.transform(chars, one)


def permute_text(text: Column, key: str, tag: str, alphabets: tuple[str, ...] = _ALPHABETS) -> Column:
    """Letters and digits permuted within their kind, other signs in place: rounds shift one half by the other's hash."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    u = F.floor(n / 2).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), u).alias("a"), F.slice(chars, u + 1, n).alias("b"))
    # a half is hashed once a round, not once for each sign, so that long values take linear time
    seed = lambda i, half: F.sha2(F.concat_ws("|", F.lit(f"{key}|{tag}"), n.cast("string"), i.cast("string"), F.array_join(half, "")), 256)
    step = lambda acc, i: F.struct(acc["b"].alias("a"), _bound(seed(i, acc["b"]), lambda s: _shift(acc["a"], s, alphabets)).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(5)), start, step, lambda acc: F.concat(F.array_join(acc["a"], ""), F.array_join(acc["b"], "")))


def _email(m: Column, key: str) -> Column:
    last = F.regexp_extract(m, r"(\.[^.]*)$", 1)
    return F.concat(permute_text(F.left(m, F.length(m) - F.length(last)), key, "email"), last)


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_~.-]+)$", 1)
    head = F.left(m, F.length(m) - F.length(value))
    new = F.when(value.rlike("^[0-9a-f]+$"), permute_text(value, key, "hex", _HEX)).otherwise(permute_text(value, key, "secret"))
    return F.concat(head, new)


def _simple(m: Column, key: str, kinds: tuple = ((PHONE, _phone), (SSN, _ssn), (DATE, _date)), out: Column | None = None) -> Column:
    """The pseudonym of a match of one of the kinds, else `out` or the match itself."""
    out = m if out is None else out
    for pattern, f in kinds:
        out = F.when(m.rlike(f"^(?:{pattern})$"), f(m, key)).otherwise(out)
    return out


def replaced(m: Column, key: str) -> Column:
    """One match: a struct of its pseudonyms in place (the match itself if nothing validates) and the number of them. What
    only looked like an IBAN or a number abroad is searched for cards."""
    other = _simple(m, key, ((ABROAD, _abroad), (PHONE, _phone), (SSN, _ssn), (DATE, _date), (IBAN, _iban), (IPV6, _ipv6), (IP, _ip), (SECRET, _secret), (EMAIL, _email)), F.lit(None).cast("string"))
    return _bound(other, lambda new: F.when(new.isNull(), _run(m, key)).otherwise(_counted(m, new)))


def pseudonym(m: Column, key: str) -> Column:
    """The text of a match after replacement."""
    return replaced(m, key)["text"]


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with pseudonyms in text and n_pii, the number of values replaced. One key links values over runs."""
    held = docs.withColumn("__pii_has", F.col("text").rlike(MAY))
    found = held.withColumn("__pii_found", F.when(F.col("__pii_has"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    new = found.withColumn("__pii_new", F.when(F.size("__pii_found") > 0, _bound(F.transform("__pii_found", lambda m: replaced(m, key)), lambda x: _joined(F.col("text"), ANY, x))))
    out = new.withColumns({"text": F.coalesce("__pii_new.text", "text"), "n_pii": F.coalesce("__pii_new.n", F.lit(0)).cast("long")})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__pii_has", "__pii_found", "__pii_new")
