"""Personal numbers and dates replaced by keyed, format-preserving pseudonyms.

Each kind is found by its form and validated (check digits, octets, calendar, area codes). A valid value is
mapped to another valid one of the same format by a Feistel network over the kind's own domain:
a pair (l, r) in Z_a x Z_b, where each round adds a keyed hash of one half to the other. This is
a permutation for any a and b, so equal values stay equal in all documents, different ones
stay different, and nobody without the key can tell which value it was.

==========  =============================================  ===========================================
kind        form and validation                            what is permuted
==========  =============================================  ===========================================
card        13-19 digits, also grouped; Luhn check digit   all digits but the last, which is set anew
phone       international, or with an area code            the digits after the country code
ssn         ddd-dd-dddd without invalid parts              (area) x (group, serial)
ip          four octets up to 255                          the 32-bit number
date        y-m-d, d/m/y, d.m.y, m/d/y of the calendar     the day, within windows of 72 900 days
email       address                                        letters and digits of the local part
secret      quoted value of a token, key or password       letters and digits of the value
==========  =============================================  ===========================================

Numbers with single spaces or dashes between them are one run, in which a card may stand beside other numbers
(its expiry, its check value). The cards of a run are whole groups of it: those grouped 4-4-4-4, 4-6-5 or not at all
first, then the whole run. What is left is searched for the other kinds, and what they leave for cards of other
groupings (up to six groups, or single digits), the longest first from left to right.

All of it is column expressions: texts are split at the matches and put together again, in one pass
and without a shuffle. Texts without a digit or @ are not searched.

Edge cases: null text stays null, empty text empty; a value that fails validation stays as it is; where groups
of a run can be read as several cards, inversion may read it in another way than the text had; repeated
rows give the same rows; all columns of the input pass through; ``text`` is replaced and
``n_pseudonyms`` and ``kinds`` (an array, in order of place) are added in place of columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table

ROUNDS = 8
# The forms of the kinds, in order of precedence.
SECRET = r"""(?i:(?<![a-z])(?:token|key|secret|password|passwd|pwd)["']?\s*[=:]\s*"[^"\s]{8,}")"""
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
DATE = r"(?<![\d./\-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/\-])(?!\.\d)"
IP = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])(?!\.\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}|\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)"
RUN = r"(?<!\d)\d(?:[ \-]?\d){12,}+"
REST = "|".join([SECRET, EMAIL, DATE, IP, SSN, PHONE])
ANY = f"{REST}|{RUN}"
# Lengths of the groups of a printed card; others are cards only where none of these is.
GROUPS = r"^(?:4-4-4-4|4-6-5|1[3-9])$"
WINDOW = 72_900
DAY_ONE = "0001-01-01"


def keyed(key: str, tag: Column, i: Column, half: Column) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substr(F.sha2(F.concat_ws("|", F.lit(key), tag, i, half.cast("string"), F.lit(key)), 256), F.lit(1), F.lit(15)), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: Column, invert: bool = False) -> Column:
    """Struct (l, r): a permutation of Z_a x Z_b."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if invert else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if invert else 1

    def step(s, i):
        even = i % 2 == 0
        half = keyed(key, tag, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(even, F.pmod(s["l"] + sign * F.pmod(half, a), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(half, b), b)).alias("r"),
        )

    return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permuted_digits(d: Column, key: str, tag: Column, invert: bool = False) -> Column:
    """A digit string of up to 18 digits, permuted among those of its length."""
    h = F.floor(F.length(d) / 2).cast("int")
    a, b = F.pow(F.lit(10), h).cast("long"), F.pow(F.lit(10), F.length(d) - h).cast("long")
    left = F.when(h > 0, F.substr(d, F.lit(1), h)).otherwise("0").cast("long")
    out = feistel(left, F.substr(d, h + 1).cast("long"), a, b, key, F.concat(tag, F.length(d).cast("string")), invert)
    return once(out, lambda s: F.concat(F.when(h > 0, F.lpad(s["l"].cast("string"), h, "0")).otherwise(""), F.lpad(s["r"].cast("string"), F.length(d) - h, "0")))


def refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order by ``digits``."""
    chars = F.split(form, "")
    fill = F.aggregate(
        chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")),
        lambda s, c: once(c.rlike("^[0-9]$"), lambda d: F.struct((s["n"] + d.cast("int")).alias("n"), F.concat(s["out"], F.when(d, F.substr(digits, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"))),
    )
    return fill["out"]


def luhn_sum(d: Column) -> Column:
    """Sum with every second digit doubled, from the last one."""
    n = F.length(d)
    digit = lambda i: F.substr(d, n - i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + once(digit(i) * (1 + i % 2), lambda x: x - 9 * (x > 9).cast("int")))


def is_card(d: Column) -> Column:
    return luhn_sum(d) % 10 == 0


def card(m: Column, key: str, invert: bool = False) -> Column:
    d = digits_of(m)
    body = permuted_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, F.lit("card"), invert)
    return once(body, lambda b: refilled(m, F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))


def card_spans(groups: Column, printed: bool) -> Column:
    """The cards of a run, as array of struct (first, last) of its groups, in order. ``printed``: those of a
    usual grouping, or else the run as a whole; otherwise the other ones."""
    n = F.size(groups)

    def spans_from(i):
        def span(j):
            part = F.slice(groups, i + 1, j - i + 1)
            return F.struct(i.alias("first"), j.alias("last"), F.array_join(part, "").alias("digits"), F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), "-").alias("form"))

        def may_be(s):
            whole = (i == 0) & (s["last"] == n - 1)
            form = s["form"].rlike(GROUPS) | whole if printed else (s["last"] - i < 6) | s["form"].rlike("^1(?:-1)+$")
            return F.when(F.length(s["digits"]).between(13, 19) & form, is_card(s["digits"])).otherwise(False)

        return F.reverse(F.filter(F.transform(F.sequence(i, F.least(i + 18, n - 1)), span), may_be))

    def step(taken, s):
        free = ~F.exists(taken, lambda t: (t["first"] <= s["last"]) & (s["first"] <= t["last"]))
        return F.when(free, F.array_append(taken, F.struct(s["first"].alias("first"), s["last"].alias("last")))).otherwise(taken)

    def chosen(every):
        """Usual groupings before the whole run; from left to right, the longest of each start."""
        usual = F.filter(every, lambda s: s["form"].rlike(GROUPS))
        order = F.concat(usual, F.filter(every, lambda s: ~s["form"].rlike(GROUPS)))
        return F.array_sort(F.aggregate(order, F.array().cast("array<struct<first:int,last:int>>"), step))

    return once(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), spans_from)), chosen)


def phone(m: Column, key: str, invert: bool = False) -> Column:
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .\-(])", 0)
    rest = F.substr(m, F.length(code) + 1)
    return once(rest, lambda r: F.concat(code, refilled(r, permuted_digits(digits_of(r), key, F.concat(F.lit("phone"), digits_of(code)), invert))))


def ip(m: Column, key: str, invert: bool = False) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    n = F.lit(1 << 16)
    out = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), n, n, key, F.lit("ip"), invert)
    return once(out, lambda s: F.concat_ws(".", *[F.pmod(F.floor(x / 256) if high else x, F.lit(256)).cast("long").cast("string") for x in (s["l"], s["r"]) for high in (True, False)]))


def ssn(m: Column, key: str, invert: bool = False) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.get(F.split(m, "-"), F.lit(i)).cast("long") for i in range(3))
    out = feistel(area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"), invert)
    back = lambda x: x + 1 + (x >= 665).cast("long")
    return once(out, lambda s: F.concat_ws("-", F.lpad(back(s["l"]).cast("string"), 3, "0"), F.lpad((F.floor(s["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["r"] % 9999 + 1).cast("string"), 4, "0")))


def is_ssn(m: Column) -> Column:
    return ~m.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$")


def date_parts(m: Column) -> Column:
    """Struct (day, order) of a date of the calendar; null if it is none. A date that can be d/m/y is."""
    p = F.transform(F.split(m, "[./-]"), lambda x: x.cast("int"))
    made = lambda y, mo, d: F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(mo.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")
    first, second, third = (F.get(p, F.lit(i)) for i in range(3))
    iso = m.rlike(r"^\d{4}-")
    found = F.when(iso, made(first, second, third)).otherwise(made(third, second, first))
    us = F.when(~iso & m.contains("/") & (second > 12), made(third, first, second))
    return F.struct(F.coalesce(found, us).alias("day"), F.when(iso, "ymd").when(found.isNotNull(), "dmy").otherwise("mdy").alias("order"))


def date(m: Column, key: str, invert: bool = False) -> Column:
    """The permutation walks on while an m/d/y date would read as d/m/y (two in five do)."""
    def permuted(n):
        window = F.floor(n / WINDOW).cast("long")
        # The last window ends with the year 9999 and has 39 x 181 days.
        last = window == 50
        out = feistel(F.floor((n - window * WINDOW) / F.when(last, 181).otherwise(270)), F.pmod(n - window * WINDOW, F.when(last, 181).otherwise(270)), F.when(last, 39).otherwise(270), F.when(last, 181).otherwise(270), key, F.concat(F.lit("date"), window.cast("string")), invert)
        return once(out, lambda s: window * WINDOW + s["l"] * F.when(last, 181).otherwise(270) + s["r"])

    day_of = lambda n: F.date_add(F.lit(DAY_ONE).cast("date"), n.cast("int"))

    def moved(p):
        start = F.datediff(p["day"], F.lit(DAY_ONE).cast("date")).cast("long")
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), permuted(start), lambda n, i: F.when((p["order"] == "mdy") & (F.dayofmonth(day_of(n)) <= 12), permuted(n)).otherwise(n))
        return once(walk, lambda n: printed(p["order"], day_of(n)))

    def printed(order, day):
        y, mo, d = F.lpad(F.year(day).cast("string"), 4, "0"), F.month(day).cast("string"), F.dayofmonth(day).cast("string")
        sep = F.regexp_extract(m, "[./-]", 0)
        # Two digits, unless the original has a part of one digit.
        wide = lambda x: F.when(m.rlike(r"(?<!\d)\d(?!\d)"), x).otherwise(F.lpad(x, 2, "0"))
        return F.when(order == "ymd", F.concat_ws("-", y, wide(mo), wide(d))).when(order == "dmy", F.concat(wide(d), sep, wide(mo), sep, y)).otherwise(F.concat(wide(mo), sep, wide(d), sep, y))

    return once(date_parts(m), moved)


def permuted_text(text: Column, key: str, tag: str, invert: bool = False) -> Column:
    """Feistel over the halves of a string: letters and digits move within their own class."""
    h = F.floor(F.length(text) / 2).cast("int")
    sign = -1 if invert else 1

    def moved(x, other, i):
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i, F.length(text).cast("string"), other, F.lit(key)), 256)

        def shifted(j, s):
            c, k = F.substr(x, j, F.lit(1)), sign * F.conv(F.substr(s, F.pmod(2 * j - 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
            turn = lambda low, n: F.char(low + F.pmod(F.ascii(c) - low + k, F.lit(n)))
            return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

        return F.when(F.length(x) == 0, x).otherwise(once(stream, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda j: shifted(j, s)), "")))

    def step(s, i):
        even = i % 2 == 0
        return F.struct(F.when(even, moved(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved(s["r"], s["l"], i)).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if invert else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    out = F.aggregate(rounds, F.struct(F.substr(text, F.lit(1), h).alias("l"), F.substr(text, h + 1).alias("r")), step)
    return once(out, lambda s: F.concat(s["l"], s["r"]))


def email(m: Column, key: str, invert: bool = False) -> Column:
    return F.concat(permuted_text(F.substring_index(m, "@", 1), key, "email", invert), F.lit("@"), F.substring_index(m, "@", -1))


def secret(m: Column, key: str, invert: bool = False) -> Column:
    value = F.regexp_extract(m, '"([^"]+)"$', 1)
    return F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(value) - 1), permuted_text(value, key, "secret", invert), F.lit('"'))


MAKERS = {"secret": secret, "email": email, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": card}


def kind_of(m: Column) -> Column:
    """The kind of a match, null if its value is not valid."""
    full = lambda pattern: m.rlike(f"^(?:{pattern})$")
    return (
        F.when(full(SECRET), "secret").when(m.contains("@"), "email")
        .when(full(DATE), F.when(date_parts(m)["day"].isNotNull(), "date"))
        .when(full(IP), F.when(F.forall(F.split(m, r"\."), lambda x: x.cast("int") <= 255), "ip"))
        .when(full(SSN), F.when(is_ssn(m), "ssn"))
        .when(full(PHONE), "phone")
    )


def piece(kind: Column, value: Column) -> Column:
    return F.array(F.struct(kind.cast("string").alias("kind"), value.alias("value")))


def pieces(text: Column, pattern: str, found=lambda m: piece(kind_of(m), m)) -> Column:
    """Array of struct (kind, value): the text between the matches, with null kinds, and ``found`` of every match."""
    each = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
    return F.flatten(F.zip_with(F.split(text, pattern, -1), each, lambda a, b: F.concat(piece(F.lit(None), a), F.coalesce(b, F.array().cast("array<struct<kind:string,value:string>>")))))


def cards_of_run(m: Column, printed: bool, rest) -> Column:
    """``pieces`` of a run: its cards, and ``rest`` of the texts before, between and after them."""
    def cut(numbers):
        joined = lambda first, last: F.array_join(F.slice(numbers, first + 1, F.greatest(last - first, F.lit(0))), "")
        head = lambda k: F.coalesce(F.regexp_extract(F.get(numbers, k), "^[ -]?", 0), F.lit(""))

        def by(spans):
            def part(s, k):
                before = F.when(k > 0, F.get(spans, k - 1)["last"] + 1).otherwise(F.lit(0))
                value = F.substr(joined(s["first"], s["last"] + 1), F.length(head(s["first"])) + 1)
                return F.struct(F.concat(joined(before, s["first"]), head(s["first"])).alias("text"), value.alias("card"))

            after = F.when(F.size(spans) > 0, F.get(spans, F.size(spans) - 1)["last"] + 1).otherwise(F.lit(0))
            parts = F.concat(F.transform(spans, part), F.array(F.struct(joined(after, F.size(numbers)).alias("text"), F.lit(None).cast("string").alias("card"))))
            return F.flatten(F.transform(parts, lambda p: F.concat(rest(p["text"]), piece(F.when(p["card"].isNotNull(), "card"), F.coalesce(p["card"], F.lit(""))))))

        # The groups once: each span reads a slice of them, so a run costs in proportion to its length.
        return once(F.transform(numbers, digits_of), lambda groups: once(card_spans(groups, printed), by))

    return once(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), cut)


def pieces_of_run(m: Column) -> Column:
    """Cards of a usual form, then the other kinds, then cards of any form in what is left."""
    last = lambda t: pieces(t, RUN, lambda r: cards_of_run(r, False, lambda x: piece(F.lit(None), x)))
    others = lambda t: F.flatten(F.transform(pieces(t, REST), lambda p: F.when(p["kind"].isNull(), last(p["value"])).otherwise(F.array(p))))
    return cards_of_run(m, True, others)


def pseudonymise(df: DataFrame, key: str, invert: bool = False) -> DataFrame:
    """``df`` with pseudonyms in ``text``; with ``invert`` and the same key the other way."""
    text = F.col("text")
    searched = F.when(text.rlike("[0-9@=:]"), text)

    def replaced(p):
        out = p["value"]
        for name, make in MAKERS.items():
            out = F.when(p["kind"] == name, make(p["value"], key, invert)).otherwise(out)
        return out

    found = pieces(searched, ANY, lambda m: F.when(m.rlike(f"^{RUN}$"), pieces_of_run(m)).otherwise(piece(kind_of(m), m)))
    names = [c for c in df.columns if c not in ("n_pseudonyms", "kinds", "text")]
    rows = df.withColumn("_found", found)
    joined = F.array_join(F.transform("_found", replaced), "")
    kinds = F.coalesce(F.filter(F.transform("_found", lambda f: f["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return rows.select(*names, F.coalesce(joined, text).alias("text"), kinds.alias("kinds")).withColumn("n_pseudonyms", F.size("kinds").cast("long"))


@query("op6_pii_pseudonyms")
def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus pseudonyms, key 1")
