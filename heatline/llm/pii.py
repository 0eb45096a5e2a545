"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

E-mail addresses, IPv4 addresses, social security numbers, dates, phone numbers and card numbers are found by one
expression and validated (calendar, octets, social security areas, Luhn; every phone number counts). A valid value becomes its image under a keyed
permutation of its own format's values, an eight-round Feistel network over two residues whose moduli multiply
to the number of values, with SHA-256 as the round function: equal values stay linked across documents, others stay
apart, and the key holder can invert it. Separators and the shape stay; a card keeps its first digit and a valid
check digit; a date stays a date within its 400-year calendar cycle. Local parts of addresses are not numbers: each
becomes a keyed digest of the whole lower-cased address under a reserved domain.

The key comes from the session's setting spark.heatline.pii.key or the variable HEATLINE_PII_KEY; without one the
operator refuses to run.

Defined results: null text stays null, empty stays empty; values that fail validation stay; null doc_ids and repeated
rows are treated like any other; an empty table gives no rows; texts of any length are matched whole (the expression
neither recurses nor backtracks over repeats without a bound) and other columns, whatever their names, pass unchanged.
Rows are independent: no shuffle.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, quoted, read_table

#: Where the key is named: a setting of the session, else of the environment.
KEY_SETTING, KEY_VARIABLE = "spark.heatline.pii.key", "HEATLINE_PII_KEY"
#: The registered query and the pipeline's stage run with this where no key is named; it protects nothing.
TEST_KEY = "test key, not for use"
ROUNDS = 8

#: Possessive, so that no text is too long for the matcher's stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
DATE = r"(?<![\w-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-])"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
CARD = r"(?<!\w)\d(?:[ -]?\d){12,18}(?!\w)"
KINDS = {"email": EMAIL, "ip": IP, "ssn": SSN, "date": DATE, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())
#: Days in 400 years of the calendar, 27 * 5411; the cycle that holds 1800 to 2199.
CYCLE = (27, 5411)
FIRST_DAY = "1800-01-01"


def configured(spark: SparkSession, otherwise: str | None = None) -> str:
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE) or otherwise
    if not key:
        raise RuntimeError(f"name a key in {KEY_SETTING} or {KEY_VARIABLE}")
    return key


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def feistel(tag: str, key: str, a: Column, b: Column, m: Column, n: Column, inverse: bool = False) -> Column:
    """A keyed permutation of the pairs (a mod m, b mod n), as struct(a, b)."""

    def noise(i: Column, x: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), m.cast("string"), n.cast("string"), x.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def forward(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, F.pmod(acc["a"] + noise(i, acc["b"]), m)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + noise(i, acc["a"]), n)).alias("b"))

    def backward(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, F.pmod(acc["a"] - noise(i, acc["b"]), m)).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] - noise(i, acc["a"]), n)).alias("b"))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), backward if inverse else forward)


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(tag: str, key: str, digits: Column, inverse: bool = False) -> Column:
    """The image of a string of 2 to 30 digits among those of its length."""
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    pair = feistel(tag, key, F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, v), power(u), power(v), inverse)
    return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), v, "0")))


def in_shape(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in turn."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("s"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct((acc["i"] + digit.cast("int")).alias("i"), F.concat(acc["s"], F.when(digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("s"))

    return F.aggregate(chars, start, step, lambda acc: acc["s"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum with every second digit doubled, from the right; doubled: 1 if the last is one of them, else 0."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    values = F.transform(chars, lambda c, i: F.when(i % 2 == 1 - doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def card(value: Column, key: str) -> Column:
    def image(d: Column) -> Column:
        body = F.concat(F.substring(d, F.lit(1), F.lit(1)), permuted_digits("card", key, F.substring(d, F.lit(2), F.length(d) - 2)))
        whole = let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(x, 1) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, 0) % 10 == 0, in_shape(value, whole)).otherwise(value)

    return let(F.regexp_replace(value, "[^0-9]", ""), image)


def phone(value: Column, key: str) -> Column:
    """Ten national digits, whatever the area code: three and seven more."""

    def image(d: Column) -> Column:
        area, rest = F.substring(d, -10, 3), F.substring(d, -7, 7)
        pair = feistel("phone", key, area, rest, F.lit(1000), F.lit(10_000_000))
        new = let(pair, lambda p: F.concat(F.substring(d, F.lit(1), F.length(d) - 10), F.lpad(p["a"].cast("string"), 3, "0"), F.lpad(p["b"].cast("string"), 7, "0")))
        return in_shape(value, new)

    return let(F.regexp_replace(value, "[^0-9]", ""), image)


def ip(value: Column, key: str) -> Column:
    def image(o: Column) -> Column:
        octet = lambda k: F.get(o, k).cast("long")
        pair = feistel("ip", key, octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), F.lit(65536), F.lit(65536))
        high, low = (lambda x: F.floor(x / 256).cast("string")), (lambda x: (x % 256).cast("string"))
        new = let(pair, lambda p: F.concat_ws(".", high(p["a"]), low(p["a"]), high(p["b"]), low(p["b"])))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), new).otherwise(value)

    return let(F.split(value, r"\."), image)


def ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = (area - 1 - (area > 666).cast("long")) * 99 + group - 1

    def shown(p: Column) -> Column:
        at = F.floor(p["a"] / 99) + 1
        return F.concat_ws("-", F.lpad((at + (at >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return F.when(valid, let(feistel("ssn", key, place, serial - 1, F.lit(898 * 99), F.lit(9999)), shown)).otherwise(value)


def date(value: Column, key: str) -> Column:
    """ISO dates, day first with points, and month first with slashes (day first where only that is a date)."""

    def image(form: str) -> Column:
        def of(day: Column) -> Column:
            at = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
            size = CYCLE[0] * CYCLE[1]
            place, era = F.pmod(at, F.lit(size)), F.floor(at / size)
            pair = feistel("date", key, F.floor(place / CYCLE[1]), place % CYCLE[1], F.lit(CYCLE[0]), F.lit(CYCLE[1]))
            new = let(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * CYCLE[1] + p["b"] + era * size).cast("int")))
            return F.coalesce(F.date_format(new, form), value)

        return let(F.try_to_timestamp(value, F.lit(form)).cast("date"), of)

    slash = F.when(F.try_to_timestamp(value, F.lit("MM/dd/yyyy")).isNotNull(), image("MM/dd/yyyy")).otherwise(image("dd/MM/yyyy"))
    return F.when(value.contains("/"), slash).when(value.contains("."), image("dd.MM.yyyy")).otherwise(image("yyyy-MM-dd"))


def email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16), F.lit("@pseudonym.invalid"))


def kind_of(value: Column) -> Column:
    out = F.when(value.contains("@"), F.lit("email"))
    for name in ("ip", "ssn", "date", "phone"):
        out = out.when(value.rlike(f"^(?:{KINDS[name]})$"), F.lit(name))
    return out.otherwise(F.lit("card"))


MAKERS = {"email": email, "ip": ip, "ssn": ssn, "date": date, "phone": phone, "card": card}


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, value) for one match."""

    def of(kind: Column) -> Column:
        out = None
        for name, make in MAKERS.items():
            out = F.when(kind == name, make(value, key)) if out is None else out.when(kind == name, make(value, key))
        return F.struct(kind.alias("kind"), value.alias("was"), out.alias("now"))

    return let(kind_of(value), of)


def pseudonymise(docs: DataFrame, key: str | None = None) -> tuple[DataFrame, str]:
    """docs with text rewritten, and the name of its added column: an array of (kind, was, now) of the values that changed, in order."""
    key = key or configured(docs.sparkSession)
    text, matches, new, changes = F.col("text"), *(fresh(docs, f"__hl_{c}") for c in ("matches", "new", "changes"))
    found = text.rlike("[0-9]|@") & text.rlike(ANY)
    kind = "array<struct<kind:string,was:string,now:string>>"
    out = docs.withColumn(matches, F.when(found, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key))).otherwise(F.array().cast(kind)))
    parts = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(parts, F.transform(matches, lambda m: m["now"]), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    out = out.withColumn(new, F.when(F.size(matches) > 0, joined).otherwise(text))
    changed = F.filter(matches, lambda m: m["was"] != m["now"])
    return out.select(*[F.col(new).alias(c) if c == "text" else quoted(c) for c in docs.columns], changed.alias(changes)), changes


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, the rewritten text and how many values of each kind were rewritten."""
    out, changes = pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    of = lambda k: F.size(F.filter(changes, lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", *[of(k) for k in KINDS])


def stage(docs: DataFrame, key: str | None = None) -> DataFrame:
    out, changes = pseudonymise(docs, key)
    return out.drop(changes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"), configured(spark, TEST_KEY))
