"""Format-preserving pseudonyms for personal data in texts (DataFrame functions only).

A value found in a text is validated, turned into symbols (digits, letters, octets or a
day number in two parts), and the symbols are permuted by a keyed Feistel network whose
every position adds modulo its own radix. So a card number becomes a card number with a
right check digit, a date a date, and equal values become equal pseudonyms everywhere,
also if they are written with other separators. What fails validation stays as it is.

The round function is HMAC-SHA-256. Its key reaches the tasks as the result of a scalar
subquery, so no plan, event log or page of the UI shows it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: Days of the 400-year cycle that begins with 1800: 146,097 = 189 * 773, so two symbols hold a date exactly.
FIRST_DAY, DAY_RADICES = "1800-01-01", (189, 773)

LOCAL = r"\p{L}\p{M}0-9._%+'\-"
EMAIL = rf"(?<![{LOCAL}])[{LOCAL}]++@" + r"(?:[A-Za-z0-9\-]++\.(?=[A-Za-z0-9\-]*+\.[A-Za-z]{2}|[A-Za-z]{2}))++[A-Za-z]{2,}+"
#: A run of digits in which cards are sought: groups that single spaces or hyphens part and no letter ends. Loops are
#: possessive, so that runs of any length need no stack.
RUN = r"(?=[0-9](?:[ \-]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ \-][0-9]++(?![A-Za-z]))*+"
CARD = rf"(?<![A-Za-z0-9.]){RUN}"
SSN = r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"
NUMBER = r"(?:\+?1[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4}"
PHONE = rf"(?<![\w+]){NUMBER}(?![\w\-])"
IP = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"
DATE = r"(?<![\w\-/.])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w\-/])"
#: What a secret follows: a name and a sign of assignment, or the scheme of an authorisation header.
ASSIGNED = r"\b(?:(?i:token|password|passwd|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?|Bearer ++)"
#: Eight characters at least, or four of which one is no letter.
SECRET = ASSIGNED + r"(?=[A-Za-z0-9+/_.\-]{8}|[A-Za-z]{0,3}[0-9+/_\-][A-Za-z0-9+/_\-]{3}|[A-Za-z]{3,6}[0-9+/_\-])[A-Za-z0-9+/_\-]++(?:\.[A-Za-z0-9+/_\-]++)*+"

KINDS = ("email", "card", "ssn", "phone", "ip", "date", "secret")
#: What can begin a match comes first, so that most characters fail at once.
ANY = f"{SECRET}|{EMAIL}|(?=[0-9+(])(?:{'|'.join((DATE, SSN, PHONE, CARD, IP))})"
#: No match without one of these.
HINT = "[0-9@=:]|Bearer "


def matches(text: Column) -> Column:
    """All candidates of a text in order; none for null."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), none)


@dataclass(frozen=True)
class Secret:
    """The key. Who holds it can recompute the pseudonym of a value; nobody else can tell values from it."""

    key: str = field(repr=False)

    def column(self) -> Column:
        """The two padded keys of HMAC, as a scalar subquery over one row that is no literal of the plan.

        To be added to a table as a column, since subqueries may not stand inside array functions.
        """
        raw = self.key.encode()
        block = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
        pads = [bytearray(x ^ pad for x in block) for pad in (0x36, 0x5C)]
        return SparkSession.active().createDataFrame([(pads,)], "k array<binary>").scalar()


def hmac_sha256(key: Column, message: Column) -> Column:
    """64 hex digits."""
    inner = F.unhex(F.sha2(F.concat(key[0], message.cast("binary")), 256))
    return F.sha2(F.concat(key[1], inner), 256)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, not at each place where ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def feistel(symbols: Column, radices: Column, key: Column, kind: str, undo: bool = False) -> Column:
    """Permutes an array of ints, each below the radix at its place; ``undo`` inverts it.

    Radix one leaves a symbol fixed. The two halves take turns: to each symbol of one half
    a keyed function of the whole other half is added, modulo the radix.
    """
    half = F.floor(F.size(symbols) / 2).cast("int")
    pack = lambda a, r: F.struct(a.alias("a"), r.alias("r"))
    left, left_r = F.slice(symbols, 1, half), F.slice(radices, 1, half)
    right, right_r = F.slice(symbols, half + 1, F.size(symbols)), F.slice(radices, half + 1, F.size(symbols))

    def turn(state: Column, step: Column) -> Column:
        mine = F.when(step % 2 == 0, pack(state["left"], state["left_r"])).otherwise(pack(state["right"], state["right_r"]))
        other = F.when(step % 2 == 0, state["right"]).otherwise(state["left"])
        said = F.concat_ws("|", F.lit(kind), step.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        digests = lambda d: F.transform(F.sequence(F.lit(0), F.floor(F.size(mine["a"]) / 8).cast("int")), lambda j: hmac_sha256(key, F.concat_ws("|", d, j.cast("string"))))
        places = F.transform(mine["a"], lambda x, j: F.struct(x.alias("x"), j.alias("j")))
        added = lambda hs, p: F.conv(F.substring(hs[F.floor(p["j"] / 8).cast("int")], (p["j"] % 8) * 8 + 1, F.lit(7)), 16, 10).cast("bigint")
        sums = lambda hs: F.zip_with(places, mine["r"], lambda p, r: F.pmod(p["x"] + F.lit(-1 if undo else 1) * added(hs, p), r.cast("bigint")))
        moved = _once(said, lambda d: _once(digests(d), sums))
        return F.struct(
            F.when(step % 2 == 0, moved).otherwise(state["left"]).alias("left"),
            F.when(step % 2 == 0, state["right"]).otherwise(moved).alias("right"),
            state["left_r"].alias("left_r"),
            state["right_r"].alias("right_r"),
        )

    start = F.struct(left.cast("array<bigint>").alias("left"), right.cast("array<bigint>").alias("right"), left_r.alias("left_r"), right_r.alias("right_r"))
    steps = F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS))])
    return F.aggregate(steps, start, turn, lambda s: F.concat(s["left"], s["right"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _symbols(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: c.cast("bigint"))


def _joined(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda x: x.cast("string")), "")


def _refill(form: Column, digits: Column) -> Column:
    """Puts the digits, in order, where ``form`` has digits."""
    put = lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(form, ""), put), "")


def luhn_sum(digits: Column, appended: int = 0) -> Column:
    """The weighted digit sum, as if ``appended`` more digits (of value 0) followed."""
    n = F.length(digits)
    each = F.transform(_symbols(digits), lambda d, i: F.when((n - i + appended) % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _card(m: Column, key: Column, undo: bool) -> Column:
    """The first digit (the network) stays, the check digit is recomputed, the rest is permuted."""
    digits = _digits(m)
    payload = F.substring(digits, F.lit(1), F.length(digits) - 1)
    radices = F.transform(_symbols(payload), lambda d, i: F.when(i == 0, 1).otherwise(10))
    symbols = F.transform(_symbols(payload), lambda d, i: F.when(i == 0, F.lit(0).cast("bigint")).otherwise(d))
    moved = F.concat(F.substring(digits, 1, 1), F.substring(_joined(feistel(symbols, radices, key, "card", undo)), F.lit(2), F.length(digits)))
    check = F.pmod(F.lit(10) - luhn_sum(moved, 1) % 10, F.lit(10))
    return _refill(m, F.concat(moved, check.cast("string")))


def is_card(m: Column) -> Column:
    digits = _digits(m)
    return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0) & digits.rlike("[1-9]")


def parts_of(run: Column) -> Column:
    """A run of digits cut into an array of (before, card): what stands before each card, and the card; the last card is empty.

    The whole run, if it is a card however it is grouped; else, from the left, the longest valid card of whole
    groups: one of 13 to 19 digits, or one of four or six digits and others of three or more.
    """
    part = lambda before, card: F.struct(before.alias("before"), card.alias("card"))
    shape = r"^(?:[0-9]{13,19}|(?:[0-9]{4}|[0-9]{6})(?:[ \-][0-9]{3,})+)$"
    between = lambda pieces, i, j: F.array_join(F.slice(pieces, i + 1, j - i), "")

    def found(pieces: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            i = k * 2
            ends = F.filter(F.sequence(i, F.least(i + 12, F.size(pieces) - 1), F.lit(2)), lambda j: _once(between(pieces, i, j + 1), lambda w: w.rlike(shape) & is_card(w)))
            taken = F.when((i > state["last"]) & F.length(pieces[i]).isin(4, 6, *range(13, 20)), F.array_max(ends))
            return _once(taken, lambda j: F.when(j.isNull(), state).otherwise(F.struct(j.alias("last"), F.concat(state["out"], F.array(F.struct(i.alias("i"), j.alias("j")))).alias("out"))))

        start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<i:int,j:int>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / 2).cast("int")), start, step, lambda s: s["out"])

    def cut(pieces: Column, cards: Column) -> Column:
        def at(k: Column) -> Column:
            begin = F.when(k == 0, 0).otherwise(F.get(cards, k - 1)["j"] + 1)
            card = F.get(cards, k)
            return F.when(k == F.size(cards), part(between(pieces, begin, F.size(pieces)), F.lit(""))).otherwise(part(between(pieces, begin, card["i"]), between(pieces, card["i"], card["j"] + 1)))

        return F.transform(F.sequence(F.lit(0), F.size(cards)), at)

    groups = F.regexp_extract_all(run, F.lit("[0-9]+|[ \\-]"), F.lit(0))  # groups at even places
    whole = F.array(part(F.lit(""), run), part(F.lit(""), F.lit("")))
    return F.when(is_card(run), whole).otherwise(_once(groups, lambda pieces: _once(found(pieces), lambda cards: cut(pieces, cards))))


def _cards(m: Column, key: Column, undo: bool) -> Column:
    """The run with the cards in it replaced. A pseudonym is valid and grouped alike, so the same cuts lead back."""
    return F.array_join(F.transform(parts_of(m), lambda p: F.when(p["card"] == "", p["before"]).otherwise(F.concat(p["before"], _card(p["card"], key, undo)))), "")


def _ssn(m: Column, key: Column, undo: bool) -> Column:
    """Area 001 to 899 but 666, group 01 to 99 and serial 0001 to 9999 stay in these ranges."""
    area = F.substring(m, 1, 3).cast("bigint")
    symbols = F.array(area - F.when(area > 666, 2).otherwise(1), F.substring(m, 5, 2).cast("bigint") - 1, F.substring(m, 8, 4).cast("bigint") - 1)
    moved = feistel(symbols, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn", undo)
    new_area = moved[0] + F.when(moved[0] >= 665, 2).otherwise(1)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", pad(new_area, 3), pad(moved[1] + 1, 2), pad(moved[2] + 1, 4))


def is_ssn(m: Column) -> Column:
    return m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _phone(m: Column, key: Column, undo: bool) -> Column:
    """Exchange codes still begin with 2 to 9; a country code stays."""
    digits = _digits(m)
    own = F.substring(digits, F.length(digits) - 9, F.lit(10))
    least = lambda i: F.when(i == 3, 2).otherwise(0)
    radices = F.array(*[F.lit(8 if i == 3 else 10) for i in range(10)])
    moved = feistel(F.transform(_symbols(own), lambda d, i: d - least(i)), radices, key, "phone", undo)
    back = _joined(F.transform(moved, lambda d, i: d + least(i)))
    return _refill(m, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), back))


def _ip(m: Column, key: Column, undo: bool) -> Column:
    octets = F.transform(F.split(m, "[.]"), lambda x: x.cast("bigint"))
    return F.array_join(F.transform(feistel(octets, F.array(*[F.lit(256)] * 4), key, "ip", undo), lambda x: x.cast("string")), ".")


def is_ip(m: Column) -> Column:
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return m.rlike(rf"^{octet}(?:\.{octet}){{3}}$")


def _date(m: Column, key: Column, undo: bool) -> Column:
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    symbols = F.array((day / DAY_RADICES[1]).cast("bigint"), day % DAY_RADICES[1])
    moved = feistel(symbols, F.array(*map(F.lit, DAY_RADICES)), key, "date", undo)
    return F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (moved[0] * DAY_RADICES[1] + moved[1]).cast("int")), "yyyy-MM-dd")


def is_date(m: Column) -> Column:
    found = F.try_to_date(m, "yyyy-MM-dd")
    return found.isNotNull() & (F.date_format(found, "yyyy-MM-dd") == m) & found.between(F.lit(FIRST_DAY), F.lit("2199-12-31"))


#: Ranges of code points that are letters or digits throughout: fixed values of Unicode.
RANGES = {"digits": (0x30, 0x39), "small": (0x61, 0x7A), "capital": (0x41, 0x5A), "latin capital": (0xC0, 0xD6), "latin small": (0xE0, 0xF6), "latin small, last": (0xF8, 0xFF), "latin capital, last": (0xD8, 0xDE), "extended": (0x100, 0x17F), "greek": (0x3B1, 0x3C9), "cyrillic capital": (0x410, 0x42F), "cyrillic small": (0x430, 0x44F), "hiragana": (0x3041, 0x3096), "katakana": (0x30A1, 0x30FA), "ideographs": (0x4E00, 0x9FEF), "hangul": (0xAC00, 0xD7A3)}


def _characters(m: Column, key: Column, kind: str, undo: bool) -> Column:
    """Letters and digits stay in their range of code points; all else stays."""
    def char(c: Column, a: Column) -> Column:
        low, radix = F.when(F.lit(False), a), F.when(F.lit(False), 1)
        for least, most in RANGES.values():
            low, radix = low.when(a.between(least, most), least), radix.when(a.between(least, most), most - least + 1)
        return F.struct(c.alias("c"), a.alias("a"), low.otherwise(a).alias("low"), radix.otherwise(1).alias("radix"))

    def moved(chars: Column) -> Column:
        steps = feistel(F.transform(chars, lambda x: (x["a"] - x["low"]).cast("bigint")), F.transform(chars, lambda x: x["radix"]), key, kind, undo)
        wide = lambda a: F.decode(F.unhex(F.lpad(F.hex(a), 4, "0")), "UTF-16BE")
        put = lambda x, y: F.when(x["radix"] == 1, x["c"]).otherwise(F.when(x["a"] < 128, F.char(x["low"] + y)).otherwise(wide(x["low"] + y)))
        return F.array_join(F.zip_with(chars, steps, put), "")

    return _once(F.transform(F.split(m, ""), lambda c: _once(F.ascii(c), lambda a: char(c, a))), moved)


def _email(m: Column, key: Column, undo: bool) -> Column:
    """The local part is permuted in its format; the domain stays."""
    return F.concat(_characters(F.substring_index(m, "@", 1), key, "email", undo), F.lit("@"), F.substring_index(m, "@", -1))


def kind_of(m: Column) -> Column:
    """The kind that a match validates as, else null."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), F.lit("email"))
        .when(whole(r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.when(is_date(m), F.lit("date")))
        .when(whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), F.when(is_ssn(m), F.lit("ssn")))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.when(is_ip(m), F.lit("ip")))
        .when(whole(NUMBER), F.lit("phone"))
        .when(whole(RUN), F.when(F.exists(parts_of(m), lambda p: p["card"] != ""), F.lit("card")))
        .when(whole(SECRET), F.lit("secret"))
    )


def pseudonym(m: Column, key: Column, undo: bool = False) -> Column:
    """What stands for a match under a ``Secret.column``; ``undo`` gets the value back from its pseudonym."""
    return _once(kind_of(m), lambda kind: _stands(m, kind, key, undo))


def _stands(m: Column, kind: Column, key: Column, undo: bool) -> Column:
    return (
        F.when(kind == "email", _email(m, key, undo))
        .when(kind == "date", _date(m, key, undo))
        .when(kind == "ssn", _ssn(m, key, undo))
        .when(kind == "ip", _ip(m, key, undo))
        .when(kind == "phone", _phone(m, key, undo))
        .when(kind == "card", _cards(m, key, undo))
        .when(kind == "secret", F.concat(F.regexp_extract(m, f"^{ASSIGNED}", 0), _characters(F.regexp_replace(m, f"^{ASSIGNED}", ""), key, "secret", undo)))
        .otherwise(m)
    )


def rewritten(text: Column, matches: Column, stands: Column) -> Column:
    """The text with each match replaced by what stands at the same place of ``stands``."""
    gaps = F.split(text, ANY, -1)
    return F.array_join(F.zip_with(gaps, stands, lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))), "")


def pseudonymise(docs: DataFrame, secret: Secret, undo: bool = False) -> DataFrame:
    """The documents with personal data in ``text`` replaced; other columns as they are.

    Null stays null, texts without matches stay the same, repeated rows change alike.
    One pass, no shuffle, no Python. Column names that begin with ``_pii_`` are reserved.
    """
    found = docs.withColumns({"_pii_found": matches(F.col("text")), "_pii_key": secret.column()})
    stands = F.when(F.size("_pii_found") > 0, F.transform("_pii_found", lambda m: pseudonym(m, F.col("_pii_key"), undo)))
    placed = found.withColumn("_pii_stands", stands)
    text = F.when(F.size("_pii_found") > 0, rewritten(F.col("text"), F.col("_pii_found"), F.col("_pii_stands"))).otherwise(F.col("text"))
    return placed.withColumn("text", text).select(*docs.columns)


def pii_report(docs: DataFrame, secret: Secret) -> DataFrame:
    """doc_id, n_found, the count of each kind, and the rewritten text of every document.

    A null text stays null and an empty one empty, with nothing found; so does a text whose
    candidates all fail validation. Repeated rows give repeated results, equal values equal
    pseudonyms. Values of any length go as a whole. No documents: no rows.

    In scope: emails (the local part), cards of 13 to 19 digits with a right check digit, alone or as whole groups
    among other digits, social security numbers, North American telephone numbers of any area code, IPv4
    addresses, ISO dates from 1800 to 2199, and secrets after a name and ``=`` or ``:``, or after ``Bearer``. A run
    of digits counts as one card, however many it holds.
    """
    found = docs.select("doc_id", "text", matches(F.col("text")).alias("found"), secret.column().alias("key"))
    each = lambda m: _once(kind_of(m), lambda kind: F.struct(kind.alias("kind"), _stands(m, kind, F.col("key"), False).alias("stands")))
    judged = found.withColumn("judged", F.when(F.size("found") > 0, F.transform("found", each)).otherwise(F.array().cast("array<struct<kind:string,stands:string>>")))
    kinds = F.transform("judged", lambda x: x["kind"])
    counted = judged.select("doc_id", "text", "found", F.transform("judged", lambda x: x["stands"]).alias("stands"), F.filter(kinds, lambda k: k.isNotNull()).alias("kinds"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    text = F.when(F.size("found") > 0, rewritten(F.col("text"), F.col("found"), F.col("stands"))).otherwise(F.col("text"))
    return counted.select("doc_id", F.size("kinds").cast("bigint").alias("n_found"), *[count(k) for k in KINDS], text.alias("text"))
