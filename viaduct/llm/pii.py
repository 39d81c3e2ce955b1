"""Format-preserving pseudonyms for personal data, by keyed Feistel networks; DataFrame functions only.

Equal values get equal pseudonyms under one key, whatever their separators, so records stay linked across documents.
What is recognised and how it is permuted:

* cards: 13 to 19 digits, optionally in groups, that pass the Luhn test; payload permuted, check digit recomputed
* IBANs that pass the mod-97 test: letters and digits of the account part permuted in their classes, check digits recomputed
* social security numbers in their valid ranges, nine digits without dashes too where they are called so: a bijection of
  exactly those ranges
* dates (year first with dashes or slashes; day and month first with dots, dashes or slashes) that exist in the years 1 to 9999: a bijection of the 146,097 days of each cycle of 400
  years, from 1800 to 2199 and so on; of slashed dates the month comes first unless the first number is above 12. Strings
  of one shape (digits of day and month, order) map to each other one to one: a day that the shape cannot show is
  permuted again until it can
* IPv4 addresses with octets up to 255, IPv6 addresses (whole or with ::) and MAC addresses: bijections of all addresses,
  so that two spellings of an IPv6 address get one pseudonym, written without ::
* telephone numbers with 10 to 15 digits and their usual marks, after 00 or with a slash behind the area code too, from 7
  digits on after a +: all but the country code permuted
* e-mail addresses (the part before the @, letters of any script, of which those of ASCII are permuted) and secrets (access
  keys, bearer tokens, password/token/secret/api_key assignments): letters and digits permuted in their classes

Cards and IBANs are recognised as whole runs of groups; of a run, the parts between group borders that pass their test are
replaced (an expiry, a year or a currency beside them stays), and dates, SSNs and telephone numbers in the rest.

Nulls stay null, empty texts stay empty, numbers that fail their validation stay as they are. Texts, e-mail addresses and
secrets may have any length. Each row is changed by itself, so repeated rows and ids stay as many as they are and an empty
table stays empty; a column n_private that docs has is replaced. Dates with the month as a word, telephone numbers of
seven digits without an area code and secrets of fewer than eight characters are not told from other text and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.llm.shared import let

ROUNDS = 8
DAYS = (189, 773)  # 189 * 773 = 146,097 days, one Gregorian cycle of 400 years
FIRST_DAY = "0001-01-01"
CYCLES = 24  # from the year 200 on; before and after them
BEFORE = 72_683  # days of the years 1 to 199
EDGES = (93, 1567)  # 93 * 1567 = 145,731 days of the years 1 to 199 and 9800 to 9999
#: Steps after which the search for a day that the shape can show ends; each step finds one with a chance above 0.2.
WALKS = 400
EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
SECRET = r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)|(?<!\w)gh[pousr]_[A-Za-z0-9]{16,}+(?!\w)|(?<!\w)(?i:bearer) [A-Za-z0-9_\-./+~]{15,}[A-Za-z0-9_\-/+~]=*+|(?i:(?<!\w)(?:password|passwd|token|secret|api_?key)\s*+[=:]\s*+[\"']?)[A-Za-z0-9_\-./+=]{7,}[A-Za-z0-9_\-/+=]"
IBAN = r"(?<!\w)(?=[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11})[A-Z0-9]++(?!\w)(?: [A-Z0-9]++(?!\w|[\-/.@]\w|\s{0,3}[=:]))*+"
MAC = r"(?<![\w:\-])(?:(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:])|(?=[\d\-]*[A-Fa-f])(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}(?![\w\-]))"
IPV6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:))(?![\w:]|\.\w)"
IPV4 = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)"
DATE = r"(?<![\w\-/.])(?:\d{4}-\d{2}-\d{2}(?:(?=T\d)|(?![\w\-/]|\.\d))|(?:\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w\-/]|\.\d))"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
NAMED_SSN = r"(?i:(?<!\w)(?:ssn|social security (?:number|no\.?))[ :#=]{1,3}+)\d{9}(?!\w|-\d)"
DOTTED_CARD = r"(?<![\w.\-])\d{4}(?:\.\d{4}){3}(?!\w|\.\d)"
CARD = r"(?<![\w\-])(?=\d(?:[ \-]?\d){12})\d++(?!\w|-(?!\d))(?:[ \-]\d++(?!\w|-(?!\d)|[/.]\d))*+"
#: Card numbers of the usual issuers: of overlapping parts that pass the Luhn test these come first.
ISSUED = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3[068]\d{12}|6\d{15,18})$"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .\-])\d{3,4}(?:[ .\-]\d{2,4}){1,2}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\w)|(?<![\w+])00\d{1,3}(?:[ .\-]\d{2,4}){3,5}(?!\w)|(?<![\w+/])0\d{2,4}/\d{5,8}(?![\w/])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, NAMED_SSN, IBAN, MAC, IPV6, DOTTED_CARD, IPV4, DATE, SSN, CARD, PHONE))
KINDS = ("email", "secret", "named_ssn", "iban", "mac", "ipv6", "dotted_card", "ipv4", "date", "ssn", "card", "phone")


def _pseudorandom(key: str, kind: str, turn: Column, other: Column) -> Column:
    """An unsigned 48-bit value from SHA-256 of key, kind, turn and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("long")


def permute_number(x: Column, a: int | Column, b: int | Column, key: str, kind: str) -> Column:
    """A keyed bijection of 0 .. a*b-1: alternating Feistel turns on the pair (x div b, x mod b), added modulo a and b."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))
    start = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).cast("long").alias("r"))

    def turn(s: Column, t: Column) -> Column:
        left = F.when(t % 2 == 0, (s["l"] + _pseudorandom(key, kind, t, s["r"])) % a).otherwise(s["l"])
        right = F.when(t % 2 == 1, (s["r"] + _pseudorandom(key, kind, t, s["l"])) % b).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])


def permute_text(s: Column, key: str, kind: str) -> Column:
    """A keyed bijection of the strings of one shape: digits, small and capital letters each stay in their class and place.

    The halves of the string change in turn, each by amounts that SHA-256 derives from the other half.
    """

    def shifted(half: Column, other: Column, t: Column) -> Column:
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), t.cast("string"), other), 256)

        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
            moved = lambda first, n: F.chr(F.lit(first) + (F.ascii(c) - first + by) % n)
            return F.when(c.rlike("^[0-9]$"), moved(48, 10)).when(c.rlike("^[a-z]$"), moved(97, 26)).when(c.rlike("^[A-Z]$"), moved(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    middle = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), middle).alias("l"), F.substr(s, middle + 1).alias("r"))

    def turn(p: Column, t: Column) -> Column:
        return F.struct(
            F.when(t % 2 == 0, shifted(p["l"], p["r"], t)).otherwise(p["l"]).alias("l"),
            F.when(t % 2 == 1, shifted(p["r"], p["l"], t)).otherwise(p["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda p: F.concat(p["l"], p["r"]))


def _bare(s: Column) -> Column:
    return F.regexp_replace(s, r"[^A-Za-z0-9]", "")


def _refill(shape: Column, bare: Column) -> Column:
    """The characters of bare in the places of the letters and digits of shape."""

    def one(c: Column, i: Column) -> Column:
        return F.when(c.rlike("^[A-Za-z0-9]$"), F.substr(bare, F.length(_bare(F.substr(shape, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum with the last digit counted once; a number is valid when it is divisible by 10."""
    every = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(every, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def _mod97(iban: Column) -> Column:
    """The account part, then country and check digits, letters as 10 to 35, modulo 97."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    return F.aggregate(
        F.split(moved, ""), F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), s * 10 + c.cast("int")).otherwise(s * 100 + F.ascii(c) - 55) % 97
    )


def _other_day(n: Column, key: str) -> Column:
    """A keyed bijection of the days of the years 1 to 9999, numbered from 0, within each cycle and within the edges."""
    cycle = DAYS[0] * DAYS[1]
    whole = CYCLES * cycle
    place = (n - BEFORE) % cycle
    inner = n - place + permute_number(place, *DAYS, key, "date")
    edge = let(permute_number(F.when(n < BEFORE, n).otherwise(n - whole), *EDGES, key, "edge date"), lambda r: F.when(r < BEFORE, r).otherwise(r + whole))
    return F.when(n.between(BEFORE, BEFORE + whole - 1), inner).otherwise(edge)


def _date(m: Column, key: str) -> Column:
    iso, slash, parts = m.rlike(r"^\d{4}[\-/]"), m.contains("/"), F.split(m, r"[\-/.]")
    mark = F.regexp_extract(m, r"[\-/.]", 0)
    day_first = ~slash | (parts[0].cast("int") > 12)
    year = F.when(iso, parts[0]).otherwise(parts[2])
    month = F.when(iso | day_first, parts[1]).otherwise(parts[0])
    day = F.when(iso, parts[2]).when(day_first, parts[0]).otherwise(parts[1])
    real = F.try_to_date(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), "yyyy-MM-dd")
    n = F.datediff(real, F.lit(FIRST_DAY).cast("date")).cast("long")
    date = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))

    def shown(d: Column) -> Column:
        return ((F.length(day) > 1) | (F.dayofmonth(d) < 10)) & ((F.length(month) > 1) | (F.month(d) < 10)) & (iso | ~slash | ~day_first | (F.dayofmonth(d) > 12))

    def walk(s: Column, _: Column) -> Column:
        further = let(_other_day(s["n"], key), lambda x: F.struct(x.alias("n"), shown(date(x)).alias("done")))
        return F.when(s["done"], s).otherwise(further)

    def text(d: Column) -> Column:
        two = lambda x, old: F.lpad(x.cast("string"), F.length(old), "0")
        y, mo, da = F.lpad(F.year(d).cast("string"), 4, "0"), two(F.month(d), month), two(F.dayofmonth(d), day)
        return F.when(iso, F.concat(y, mark, mo, mark, da)).when(day_first, F.concat(da, mark, mo, mark, y)).otherwise(F.concat(mo, mark, da, mark, y))

    new = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.struct(n.alias("n"), F.lit(False).alias("done")), walk, lambda s: F.when(s["done"], s["n"]))
    return F.when(n >= 0, F.coalesce(let(new, lambda x: text(date(x))), m)).otherwise(m)


def permute_hex(h: Column, half: int, key: str, kind: str) -> Column:
    """A keyed bijection of the strings of 2 * half small hexadecimal digits, half at most 16: Feistel turns by XOR."""
    number = lambda s: F.conv(s, 16, -10).cast("long")
    seed = lambda t, other: number(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), t.cast("string"), other.cast("string")), 256), 1, half))

    def turn(s: Column, t: Column) -> Column:
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(seed(t, s["r"])).alias("r"))

    start = F.struct(number(F.substring(h, 1, half)).alias("l"), number(F.substring(h, half + 1, half)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.lower(F.concat(F.lpad(F.hex(s["l"]), half, "0"), F.lpad(F.hex(s["r"]), half, "0"))))


def _cased(m: Column, s: Column) -> Column:
    return F.when(m.rlike("[A-F]"), F.upper(s)).otherwise(s)


def _mac(m: Column, key: str) -> Column:
    new = permute_hex(F.lower(_bare(m)), 6, key, "mac")
    mark = F.substring(m, 3, 1)
    return let(new, lambda h: _cased(m, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(F.when(i > 0, mark).otherwise(""), F.substr(h, 2 * i + 1, F.lit(2)))), "")))


def _ipv6(m: Column, key: str) -> Column:
    groups = lambda s: F.filter(F.split(F.coalesce(s, F.lit("")), ":"), lambda g: g != "")
    sides = F.split(m, "::")
    left, right = groups(F.get(sides, 0)), groups(F.get(sides, 1))
    given = F.size(left) + F.size(right)
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), right)
    bits = F.array_join(F.transform(every, lambda g: F.lpad(F.lower(g), 4, "0")), "")
    spelt = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substr(h, 4 * i + 1, F.lit(4)), "^0{1,3}", "")), ":")
    whole = F.when(m.contains("::"), (F.size(sides) == 2) & (given <= 7)).otherwise(given == 8)
    return F.when(whole, let(permute_hex(bits, 16, key, "ipv6"), lambda h: _cased(m, spelt(h)))).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda c: c.cast("long"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = let(value, lambda v: permute_number(v, 65536, 65536, key, "ipv4"))
    out = let(new, lambda v: F.concat_ws(".", *[(F.shiftright(v, s).bitwiseAND(255)).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.array_max(octets) <= 255, out).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.element_at(F.split(m, "-"), i).cast("long") for i in (1, 2, 3))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    new = let(index, lambda x: permute_number(x, 898 * 99, 9999, key, "ssn"))

    def shown(x: Column) -> Column:
        rest = (x - x % 9999) / 9999
        first = F.floor(rest / 99) + 1
        return F.format_string("%03d-%02d-%04d", (first + (first >= 666).cast("long")).cast("long"), (rest.cast("long") % 99 + 1), x % 9999 + 1)

    return F.when(valid, let(new, shown)).otherwise(m)


def _named_ssn(m: Column, key: str) -> Column:
    digits = F.substr(m, F.length(m) - 8)
    dashed = F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4))
    return F.concat(F.substr(m, F.lit(1), F.length(m) - 9), F.replace(_ssn(dashed, key), F.lit("-"), F.lit("")))


def _dotted_card(m: Column, key: str) -> Column:
    return F.when(luhn_sum(_bare(m)) % 10 == 0, _card(m, key)).otherwise(m)


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        payload = permute_text(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")
        whole = let(payload, lambda p: F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))
        return let(whole, lambda w: _refill(m, w))

    return let(_bare(m), new)


def _iban(m: Column, key: str) -> Column:
    def new(b: Column) -> Column:
        account = permute_text(F.substr(b, F.lit(5)), key, "iban")
        bare = let(account, lambda x: F.concat(F.substring(b, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(b, 1, 2), F.lit("00"), x))).cast("string"), 2, "0"), x))
        return let(bare, lambda w: _refill(m, w))

    return let(_bare(m), new)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(?:\+|00)\d{1,3}(?=[ .\-(])", 0)
    code = F.when(code != "", code).otherwise(F.regexp_extract(m, r"^\+\d", 0))
    rest = let(F.substr(m, F.length(code) + 1), lambda r: _refill(r, permute_text(_bare(r), key, "phone")))
    return F.when(F.length(_bare(m)).between(F.when(m.startswith("+"), 7).otherwise(10), F.lit(15)), F.concat(code, rest)).otherwise(m)


def _assigned(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|gh[pousr]_|(?i:bearer) |[A-Za-z_]+\s*[=:]\s*[\"']?)", 0)
    return F.concat(head, permute_text(F.substr(m, F.length(head) + 1), key, "secret"))


def _email(m: Column, key: str) -> Column:
    return F.concat(permute_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


PATTERNS = dict(zip(KINDS, (EMAIL, SECRET, NAMED_SSN, IBAN, MAC, IPV6, DOTTED_CARD, IPV4, DATE, SSN, CARD, PHONE), strict=True))
CHANGES = {"email": _email, "secret": _assigned, "named_ssn": _named_ssn, "iban": _iban, "mac": _mac, "ipv6": _ipv6, "dotted_card": _dotted_card, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
#: Runs are recognised before they are cut into parts; of both, the test, the group with the separator before it, the
#: least and most characters of a part, what its first group looks like and the shape of a single number.
RUNS = {
    "card": (lambda b: luhn_sum(b) % 10 == 0, r"[ \-]?\d+", (13, 19), r"\d$", r"^(?:[ \-]?\d){13,19}$"),
    "iban": (lambda b: F.when(b.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), _mod97(b) == 1).otherwise(F.lit(False)), r" ?[A-Z0-9]+", (15, 34), r"^ ?[A-Z]{2}(?:\d|$)", r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"),
}


def _piece(kind: Column | str, s: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), s.alias("s"))


def _each(pieces: Column, kind: str, use) -> Column:
    """pieces with use(string), pieces again, in the place of those of this kind."""
    return F.flatten(F.transform(pieces, lambda p: F.when(p["kind"] == kind, use(p["s"])).otherwise(F.array(_piece(p["kind"], p["s"])))))


def _scanned(t: Column, kinds: tuple[str, ...]) -> Column:
    """Pieces of t: recognised strings, of the first kind whose pattern fits wholly, runs as "<kind> run"; plain between."""
    any_ = "|".join(f"(?:{PATTERNS[k]})" for k in kinds)

    def kind_of(m: Column) -> Column:
        out = F.when(F.lit(False), "plain")
        for k in kinds:
            out = out.when(m.rlike(f"^(?:{PATTERNS[k]})$"), f"{k} run" if k in RUNS else k)
        return out.otherwise("plain")

    found = F.transform(F.regexp_extract_all(t, F.lit(any_), F.lit(0)), lambda m: _piece(kind_of(m), m))
    gaps = F.transform(F.split(t, any_, -1), lambda g: _piece("plain", g))
    return F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))


def _valid_parts(m: Column, kind: str) -> Column:
    """Groups and the valid parts of a run, parts as (rank, short, i, j) from the i-th to the j-th group, best first:
    the whole run, then issued card numbers, then longer parts, then those further left."""
    valid, token, (least, most), head, _ = RUNS[kind]

    def tried(groups: Column) -> Column:
        n = F.size(groups)

        def lengths(i: Column) -> Column:
            """(j, characters of the groups from the i-th to the j-th) as far as a part can reach, in one pass over them."""
            near = F.slice(groups, i, F.least(n - i + 1, F.lit(most)))
            sizes = F.transform(near, lambda g: F.length(_bare(g)))
            return F.filter(F.transform(sizes, lambda _, k: F.struct((i + k).alias("j"), F.aggregate(F.slice(sizes, 1, k + 1), F.lit(0), lambda s, x: s + x).alias("size"))), lambda c: c["size"].between(least, most))

        def one(i: Column, j: Column) -> Column:
            rank = lambda b: F.when((i == 1) & (j == n), 0).when(b.rlike(ISSUED), 1).otherwise(2).alias("rank")
            return let(_bare(F.array_join(F.slice(groups, i, j - i + 1), "")), lambda b: F.struct(rank(b), (-F.length(b)).alias("short"), i.alias("i"), j.alias("j"), valid(b).alias("ok")))

        parts = lambda i: F.filter(F.transform(lengths(i), lambda c: one(i, c["j"])), lambda c: c["ok"])
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at(groups, i).rlike(head))
        every = F.flatten(F.transform(starts, parts))
        return F.struct(groups.alias("groups"), F.array_sort(every).alias("parts"))

    return let(F.regexp_extract_all(m, F.lit(token), F.lit(0)), tried)


def _cut(run: Column, kind: str) -> Column:
    """Pieces of a run whose parts are found: of this kind where parts pass, no two overlapping, "rest" between them,
    "failed" where none passes in a run that has the shape of a single number."""

    def apart(taken: Column, c: Column) -> Column:
        meets = F.exists(taken, lambda k: (k["i"] <= c["j"]) & (c["i"] <= k["j"]))
        return F.when(meets, taken).otherwise(F.concat(taken, F.array(F.struct(c["i"].alias("i"), c["j"].alias("j")))))

    groups = run["groups"]
    between = lambda i, j: F.array_join(F.slice(groups, i, j - i + 1), "")
    single = F.array_join(groups, "").rlike(RUNS[kind][4]) & ~F.element_at(groups, 1).rlike("^00")

    def pieces(ks: Column) -> Column:
        n = F.size(ks)
        before = lambda x: F.coalesce(F.get(ks, x - 1)["j"], F.lit(0))
        parts = F.flatten(F.transform(ks, lambda k, x: F.array(_piece("rest", between(before(x) + 1, k["i"] - 1)), _piece(kind, between(k["i"], k["j"])))))
        return F.concat(parts, F.array(_piece(F.when((n == 0) & single, "failed").otherwise("rest"), between(before(n) + 1, F.size(groups)))))

    return let(F.array_sort(F.aggregate(run["parts"], F.array().cast("array<struct<i:int,j:int>>"), apart)), pieces)


def _runs_cut(docs: DataFrame, kind: str) -> DataFrame:
    """_pieces with the runs of this kind cut; a step of its own for the parts, so that no expression nests too deep."""
    parts = F.transform("_pieces", lambda p: F.when(p["kind"] == f"{kind} run", _valid_parts(p["s"], kind)))
    docs = docs.withColumn("_parts", parts)
    cut = F.zip_with("_pieces", "_parts", lambda p, r: F.when(p["kind"] == f"{kind} run", _cut(r, kind)).otherwise(F.array(_piece(p["kind"], p["s"]))))
    return docs.withColumn("_pieces", F.flatten(cut)).drop("_parts")


def replaced(m: Column, kind: Column, key: str) -> Column:
    out = F.when(kind == "plain", m)
    for k, change in CHANGES.items():
        out = out.when(kind == k, change(m, key))
    return out.otherwise(m)


def private_documents(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its text pseudonymised in place and a column n_private, the number of values that changed; other
    columns stay as they are."""
    # most texts hold no digit, @ or assignment: they never reach the patterns
    t = F.col(text)
    out = docs.withColumn("_pieces", F.when(t.rlike(r"[0-9@=:]|[Bb][Ee][Aa][Rr][Ee][Rr] |gh[pousr]_"), _scanned(t, KINDS)).otherwise(F.array(_piece("plain", t))))
    # a single number that fails its test is no telephone number
    out = _runs_cut(out, "iban")
    out = out.withColumn("_pieces", _each(_each(F.col("_pieces"), "failed", lambda s: _scanned(s, ("card",))), "rest", lambda s: _scanned(s, ("card", "phone"))))
    out = _runs_cut(out, "card")
    out = out.withColumn("_pieces", _each(_each(F.col("_pieces"), "failed", lambda s: _scanned(s, ("date", "ssn"))), "rest", lambda s: _scanned(s, ("date", "ssn", "phone"))))
    out = out.withColumn("_new", F.transform("_pieces", lambda p: replaced(p["s"], p["kind"], key)))
    changed = F.size(F.filter(F.zip_with("_pieces", "_new", lambda p, b: p["s"] != b), lambda x: x)).cast("long")
    return out.withColumns({"n_private": changed, text: F.when(t.isNotNull(), F.array_join("_new", ""))}).drop("_pieces", "_new")
