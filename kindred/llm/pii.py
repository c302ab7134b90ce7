"""Format-preserving pseudonyms for personal numbers and dates, in built-in functions only.

Values are found by pattern and validated: payment cards (Luhn), IBANs (mod 97), US social
security numbers, telephone numbers, IPv4 addresses and calendar dates; mail addresses too.
A valid value is permuted by a keyed Feistel network over the domain of its kind and written
back in its own format, with its separators and a right check digit. A value gives the same
pseudonym in every document, and different values different ones. What is not valid (a number
that fails its check digit, an octet over 255, a 30 February) stays as it is.

Numbers are pairs (x, y) of Z_a x Z_b; each round adds a keyed hash of one half to the other, so
any domain a * b is permuted exactly. Strings are halves whose letters and digits are shifted
within their class by a keyed hash of the other half.

Null texts stay null, empty ones empty; without a value a text is unchanged. Repeated rows give
equal results. All other columns stay, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8
KEY = "kindred"  # for tests alone: who knows the key can turn pseudonyms back
KEY_CONF = "spark.kindred.pii.key"
# Patterns by kind, in the order in which they are tried at a place.
PATTERNS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "iso": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])",
    "slash": r"(?<![0-9/.])[0-9]{1,2}([/.])[0-9]{1,2}\{0}[0-9]{4}(?![0-9/])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\{1}[0-9]{4}\{1}[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\{2}[0-9]{4,5})(?![0-9])",
}


def _pattern() -> str:
    """All kinds as one pattern; back references are numbered through."""
    out, groups = [], 0
    for p in PATTERNS.values():
        own = p.count("([/.])") + p.count("([ -])")
        if r"\{0}" in p:
            p = p.replace(r"\{0}", rf"\{groups + 1}")
        p = p.replace(r"\{1}", rf"\{groups + 1}").replace(r"\{2}", rf"\{groups + 2}")
        groups += own
        out.append(p)
    return "|".join(out)


def session_key(spark: SparkSession) -> str:
    """The key named in spark.kindred.pii.key; where that is unset the published one, with a warning."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        warnings.warn(f"{KEY_CONF} is not set: pseudonyms use a published key and can be turned back", stacklevel=3)
    return key or KEY


def let(value: Column, f) -> Column:
    """f(value) with value written, and evaluated, once."""
    return F.transform(F.array(value), f)[0]


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def keyed(key: str, kind, turn: Column, value: Column) -> Column:
    """48 bits of a keyed hash."""
    h = F.sha2(F.concat_ws("|", F.lit(key), _col(kind), turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("long")


def permute_pair(key: str, kind, x: Column, y: Column, a, b) -> Column:
    """struct(x, y): a keyed permutation of Z_a x Z_b."""

    def turn(s: Column, i: Column) -> Column:
        x, y = s["x"], s["y"]
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(x + keyed(key, kind, i, y), _col(a))).otherwise(x).alias("x"),
            F.when(even, y).otherwise(F.pmod(y + keyed(key, kind, i, x), _col(b))).alias("y"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)


def _shifted(c: Column, by: Column) -> Column:
    move = lambda first, n: F.char(F.lit(first) + (F.ascii(c) - first + by) % n)
    return F.when(c.between("0", "9"), move(48, 10)).when(c.between("A", "Z"), move(65, 26)).when(c.between("a", "z"), move(97, 26)).otherwise(c)


def permute_text(key: str, kind: str, s: Column) -> Column:
    """A keyed permutation of the strings with the same classes of letters and digits at the same places."""

    def chars(part: Column, h: Column) -> Column:
        n = F.length(part)
        one = lambda i: _shifted(part.substr(i, F.lit(1)), F.conv(F.substr(h, (i - 1) % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int"))
        return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), n), one), ""))

    def turn(acc: Column, i: Column) -> Column:
        h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), acc["r"]), 512)
        return F.struct(acc["r"].alias("l"), let(h, lambda h: chars(acc["l"], h)).alias("r"))

    half = (F.length(s) / 2).cast("int")
    start = F.struct(s.substr(F.lit(1), half).alias("l"), s.substr(half + 1, F.length(s)).alias("r"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn), lambda out: F.concat(out["l"], out["r"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def refill(shape: Column, new: Column) -> Column:
    """shape with its digits replaced by those of new, in turn."""

    def fill(new: Column) -> Column:
        def one(i: Column) -> Column:
            c = shape.substr(i, F.lit(1))
            return F.when(c.between("0", "9"), new.substr(F.length(digits(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")

    return let(new, fill)


def luhn_sum(d: Column) -> Column:
    """Sum of the digits, every second from the right but one doubled; 0 mod 10 if valid."""

    def add(acc: Column, i: Column) -> Column:
        v = d.substr(F.length(d) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def card(key: str, m: Column) -> Column:
    """First digit and length stay; the last digit is the new check digit."""

    def new(d: Column) -> Column:
        a = ((F.length(d) - 2) / 2).cast("int")  # digits of the first half, and of the second
        b = F.length(d) - 2 - a
        ten = lambda n: F.pow(F.lit(10), n).cast("long")
        p = permute_pair(key, F.concat(F.lit("card"), F.length(d).cast("string")), d.substr(F.lit(2), a), d.substr(a + 2, b), ten(a), ten(b))
        body = let(p, lambda p: F.concat(d.substr(1, 1), F.lpad(p["x"].cast("string"), a, F.lit("0")), F.lpad(p["y"].cast("string"), b, F.lit("0"))))
        return let(body, lambda t: F.concat(t, F.pmod(-luhn_sum(F.concat(t, F.lit("0"))), F.lit(10)).cast("string")))

    return let(digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, refill(m, new(d))).otherwise(m))


def phone(key: str, m: Column) -> Column:
    """The last ten digits: area codes from 200 within themselves, others within themselves."""

    def new(d: Column) -> Column:
        n = F.length(d)
        area, rest = d.substr(n - 9, F.lit(3)).cast("long"), d.substr(n - 6, F.lit(7)).cast("long")
        high = area >= 200
        low = F.when(high, 200).otherwise(0)
        p = permute_pair(key, F.when(high, "phone").otherwise("phone0"), area - low, rest, F.when(high, 800).otherwise(200), 10**7)
        return let(p, lambda p: F.concat(d.substr(F.lit(1), n - 10), F.lpad((p["x"] + low).cast("string"), 3, "0"), F.lpad(p["y"].cast("string"), 7, "0")))

    return refill(m, let(digits(m), new))


def ssn(key: str, m: Column) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""

    def new(o: Column) -> Column:
        area, group, serial = o[0], o[1], o[2]
        p = permute_pair(key, "ssn", F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)

        def back(p: Column) -> Column:
            area = F.when(p["x"] >= 665, p["x"] + 2).otherwise(p["x"] + 1)
            return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(p["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["y"] % 9999 + 1).cast("string"), 4, "0"))

        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(ok, let(p, back)).otherwise(m)

    return let(F.split(m, "-").cast("array<long>"), new)


def ip(key: str, m: Column) -> Column:
    def new(o: Column) -> Column:
        p = permute_pair(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        back = lambda p: F.concat_ws(".", *(x.cast("string") for h in "xy" for x in (F.floor(p[h] / 256), p[h] % 256)))
        return F.when(F.array_max(o) <= 255, let(p, back)).otherwise(m)

    return let(F.split(m, r"\.").cast("array<long>"), new)


def day(key: str, date: Column) -> Column:
    """Days permuted within their Gregorian cycle of 400 years = 146097 = 189 * 773 days, cycles counted from 1600-01-01."""

    def new(n: Column) -> Column:  # days since 1600-01-01
        r = F.pmod(n, F.lit(146097))
        p = permute_pair(key, "day", F.floor(r / 773), r % 773, 189, 773)
        return let(p, lambda p: F.date_from_unix_date((n - F.pmod(n, F.lit(146097)) + p["x"] * 773 + p["y"] - 135140).cast("int")))

    return let(F.unix_date(date) + 135140, new)


def iso_date(key: str, m: Column) -> Column:
    return let(F.try_to_date(m, "yyyy-MM-dd"), lambda d: F.when(d.isNotNull() & (F.year(d) >= 1600), F.date_format(day(key, d), "yyyy-MM-dd")).otherwise(m))


def slash_date(key: str, m: Column) -> Column:
    """Day first unless only month first is a date; one-digit days and months stay without zeros if the value had them."""

    def new(o: Column) -> Column:
        made = lambda d, mo: F.try_to_date(F.concat_ws("-", o[2], F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        bare = (F.length(o[0]) == 1) | (F.length(o[1]) == 1)
        sep = F.regexp_extract(m, "[/.]", 0)

        def back(first: Column, n: Column) -> Column:
            part = lambda x: F.when(bare, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))
            a, b = F.when(first, F.dayofmonth(n)).otherwise(F.month(n)), F.when(first, F.month(n)).otherwise(F.dayofmonth(n))
            return F.concat(part(a), sep, part(b), sep, F.lpad(F.year(n).cast("string"), 4, "0"))

        def dated(d: Column) -> Column:  # whether day first, and the date
            return F.when(d["d"].isNotNull() & (F.year(d["d"]) >= 1600), let(day(key, d["d"]), lambda n: back(d["first"], n))).otherwise(m)

        first = lambda x: F.struct(x.isNotNull().alias("first"), F.coalesce(x, made(o[1], o[0])).alias("d"))
        return let(let(made(o[0], o[1]), first), dated)

    return let(F.split(m, "[/.]"), new)


def mod97(s: Column) -> Column:
    """Of a string of digits and capital letters, letters as 10 to 35."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(s, "(?<=.)(?=.)"), F.lit(0), add)


def iban(key: str, m: Column) -> Column:
    """Country and the classes of the account's signs stay; the check digits are new."""

    def new(s: Column) -> Column:
        country, account = s.substr(1, 2), s.substr(F.lit(5), F.length(s))
        ok = F.length(s).between(15, 34) & (mod97(F.concat(account, s.substr(1, 4))) == 1)
        full = let(permute_text(key, "iban", account), lambda t: F.concat(country, F.lpad((98 - mod97(F.concat(t, country, F.lit("00")))).cast("string"), 2, "0"), t))

        def spaced(full: Column) -> Column:
            def one(i: Column) -> Column:
                c = m.substr(i, F.lit(1))
                return F.when(c == " ", c).otherwise(full.substr(F.length(F.replace(F.substr(m, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))

            return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), one), "")

        return F.when(ok, let(full, spaced)).otherwise(m)

    return let(F.replace(m, F.lit(" "), F.lit("")), new)


def mail(key: str, m: Column) -> Column:
    """The local part; the domain stays. Equal addresses count as such whatever their letters' case."""
    return F.concat(let(F.lower(F.substring_index(m, "@", 1)), lambda t: permute_text(key, "mail", t)), F.lit("@"), F.substring_index(m, "@", -1))


def pseudonym(key: str, m: Column) -> Column:
    is_ = lambda kind: m.rlike("^(?:" + PATTERNS[kind].replace(r"\{0}", r"\1").replace(r"\{1}", r"\1").replace(r"\{2}", r"\2") + ")$")
    return (
        F.when(m.contains("@"), mail(key, m))
        .when(is_("iban"), iban(key, m))
        .when(is_("iso"), iso_date(key, m))
        .when(is_("slash"), slash_date(key, m))
        .when(is_("ip"), ip(key, m))
        .when(is_("phone"), phone(key, m))
        .when(is_("ssn"), ssn(key, m))
        .otherwise(card(key, m))
    )


def pseudonymize(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """docs with its text column rewritten; nothing else changes, and no row moves. Without a key the session's counts."""
    return docs.withColumn(text, _parts(F.col(text), key or session_key(docs.sparkSession))[0])


def _parts(text: Column, key: str) -> tuple[Column, Column]:
    """(new text, number of values replaced), of one struct so that values are found and permuted once."""
    pattern = _pattern()

    def weave(pairs: Column) -> Column:
        new = F.transform(pairs, lambda p: p["new"])
        woven = F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.struct(woven.alias("text"), F.size(F.filter(pairs, lambda p: p["old"] != p["new"])).alias("n"))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(found, lambda m: F.struct(m.alias("old"), pseudonym(key, m).alias("new")))
    # Texts without any of these signs hold no value; most texts end here.
    done = F.when(text.rlike("[0-9@]"), let(pairs, weave)).otherwise(F.struct(text.alias("text"), F.when(text.isNotNull(), 0).alias("n")))
    return done["text"], done["n"]


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = _parts(F.col("text"), session_key(spark))
    done = documents(spark, sf_dir).select("doc_id", F.struct(text.alias("text"), n.alias("n")).alias("r"))
    return done.select("doc_id", F.col("r.text").alias("text"), F.col("r.n").alias("n_replaced"))
