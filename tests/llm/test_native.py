"""The operators in DataFrame functions against plain versions, and texts that try their limits."""

import collections
import datetime
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from heatline.llm import common, pii, quality, secrets, simhash

from .test_llm import SF, WORD, docs, multiset, texts  # noqa: F401

# -- pseudonyms


def feistel(tag, key, a, b, m, n):
    for i in range(pii.ROUNDS):
        noise = int(hashlib.sha256(f"{key}|{tag}|{i}|{m}|{n}|{a if i % 2 else b}".encode()).hexdigest()[:15], 16)
        a, b = ((a + noise) % m, b) if i % 2 == 0 else (a, (b + noise) % n)
    return a, b


def shaped(shape, digits):
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def luhn(digits, doubled):
    return sum((2 * d - 9 * (d > 4)) if k % 2 == 1 - doubled else d for k, d in enumerate(int(c) for c in reversed(digits)))


def plain_date(value, form, key):
    try:
        day = datetime.datetime.strptime(value, form).date()
    except ValueError:
        return None
    at, size = (day - datetime.date(1800, 1, 1)).days, 27 * 5411
    place, era = at % size, at // size
    a, b = feistel("date", key, place // 5411, place % 5411, 27, 5411)
    new = datetime.date(1800, 1, 1) + datetime.timedelta(days=a * 5411 + b + era * size)
    return {"%Y-%m-%d": f"{new.year:04d}-{new.month:02d}-{new.day:02d}", "%m/%d/%Y": f"{new.month:02d}/{new.day:02d}/{new.year:04d}", "%d/%m/%Y": f"{new.day:02d}/{new.month:02d}/{new.year:04d}", "%d.%m.%Y": f"{new.day:02d}.{new.month:02d}.{new.year:04d}"}[form]


def plain(value, key):
    digits = re.sub("[^0-9]", "", value)
    kind = "email" if "@" in value else next((k for k in ("ip", "ssn", "date", "phone") if re.fullmatch(pii.KINDS[k], value, re.A)), "card")
    new = value
    if kind == "email":
        new = "u" + hashlib.sha256(f"{key}|email|{value.lower()}".encode()).hexdigest()[:16] + "@pseudonym.invalid"
    elif kind == "ip" and all(int(x) < 256 for x in value.split(".")):
        o = [int(x) for x in value.split(".")]
        a, b = feistel("ip", key, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        new = f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    elif kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        if 0 < area < 900 and area != 666 and group and serial:
            a, b = feistel("ssn", key, (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
            at = a // 99 + 1
            new = f"{at + (at >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    elif kind == "date":
        forms = ("%m/%d/%Y", "%d/%m/%Y") if "/" in value else ("%d.%m.%Y",) if "." in value else ("%Y-%m-%d",)
        new = next((d for f in forms if (d := plain_date(value, f, key))), value)
    elif kind == "phone":
        a, b = feistel("phone", key, int(digits[-10:-7]), int(digits[-7:]), 1000, 10**7)
        new = shaped(value, f"{digits[:-10]}{a:03d}{b:07d}")
    elif kind == "card" and luhn(digits, 0) % 10 == 0:
        body = digits[1:-1]
        u = len(body) // 2
        v = len(body) - u
        a, b = feistel("card", key, int(body[:u]), int(body[u:]), 10**u, 10**v)
        whole = f"{digits[0]}{a:0{u}d}{b:0{v}d}"
        new = shaped(value, whole + str(-luhn(whole, 1) % 10))
    return kind, new


PLANTED = [
    "a.b+c@mail.example.com, A.B+C@MAIL.example.com. x@y x@y.z@q.r", "10.0.0.300 10.1.2.3 255.255.255.255 1.2.3.4.5", "123-45-6789 000-12-3456 666-12-3456 667-01-0001 899-99-9999 900-12-3456 001-01-0001",
    "2020-02-30 2020-02-29 03/04/2021 31/12/1999 13/13/2000 31.12.1999 0001-01-05 1800-01-01 2199-12-31", "+1 (212) 555-0101 212-555-0101 1.017.555.7713 (017) 555 7713 +1(212)555-0101",
    "4111 1111 1111 1111 4111111111111112 4111-1111-1111-1111 0000000000000 6011000990139424 378282246310005", "", None, "no data", "٣-٤ é@ü.de 𝟙𝟚𝟛-𝟜𝟝-𝟞𝟟𝟠𝟡 😀a@b.co",
]


def test_pseudonyms_by_brute_force(spark, docs):  # noqa: F811
    odd = spark.createDataFrame(list(enumerate(PLANTED, 2_000_000)), "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want, kinds = [], collections.Counter()
    for d, t in rows:
        n = collections.Counter()

        def new(m, n=n):
            kind, now = plain(m[0], "k")
            n[kind] += now != m[0]
            return now

        want.append((d, None if t is None else re.sub(pii.ANY, new, t, flags=re.A), *(n[k] for k in pii.KINDS)))
        kinds += n
    assert multiset(map(tuple, pii.report(table, "k").collect())) == multiset(want)
    assert all(kinds[k] > 1 for k in pii.KINDS)


def test_a_million_labels_and_clashing_names(spark):
    rows = [(1, "x@" + "a." * 1_000_000 + "com. y", 1, 2, 3), (2, "a@b.co.", 4, 5, 6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, __hl_matches int, __hl_NEW int, `odd.name` int")
    got = {r["doc_id"]: r for r in pii.stage(table, "k").collect()}
    assert re.fullmatch(r"u[0-9a-f]{16}@pseudonym\.invalid\. y", got[1]["text"]) and got[2]["text"].endswith("@pseudonym.invalid.")
    assert got[1].asDict().keys() == {"doc_id", "text", "__hl_matches", "__hl_NEW", "odd.name"} and tuple(got[2])[2:] == (4, 5, 6)


def test_no_key_no_pseudonyms(spark, monkeypatch):
    table = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    monkeypatch.delenv(pii.KEY_VARIABLE, raising=False)
    with pytest.raises(RuntimeError):
        pii.stage(table)
    monkeypatch.setenv(pii.KEY_VARIABLE, "one")
    assert pii.stage(table).first()["text"] == pii.stage(table, "one").first()["text"] != pii.stage(table, "two").first()["text"]


# -- secrets

ADDED = ["ghp_" + "a1B2" * 9 + " ghz_" + "a" * 40, "xoxb-1234567890-abc", "AIza" + "x_-0" * 9, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abc_DEF-1234567890", "-----BEGIN RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY-----", "PassWord: 'hunter22' api_key=ABCDEF apikey = \"x\" token=token:abcdef", "AKIA" + "Q" * 15 + " AKIA" + "Q" * 16 + "akia", "é" * 5 + "0" * 24 + "F" + "a" * 23]


def plain_spans(text, rules=secrets.RULES):
    found = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.A | (re.I if r.any_case else 0)):
            if len(m.group(r.group)) >= r.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_all_spans_by_brute_force(spark, docs):  # noqa: F811
    odd = spark.createDataFrame(list(enumerate(ADDED * 2, 2_000_000)), "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd)
    want = [(d, ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in plain_spans(t))) for d, t in texts(table)]
    assert {x.split(":")[0] for _, w in want for x in w.split(",") if x} == {r.kind for r in secrets.RULES}
    got = secrets.digest(secrets.scan(table)).collect()
    assert multiset((r["doc_id"], r["spans"]) for r in got) == multiset(want)


def test_forty_rules_and_an_index_kept_for_others(spark, monkeypatch):
    rules = tuple(secrets.Rule(f"k{k}", f"key{k:02d}[a-z]+", 0, 6) for k in range(40))
    rows = [(k, f"a key{k % 40:02d}abc key{k % 7:02d}x-key{k % 7:02d}") for k in range(3000)]
    table = common.written(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "t")
    want = multiset((d, tuple(plain_spans(t, rules))) for d, t in rows)
    index = common.written(secrets.postings(table, rules), "index")
    for sent in (secrets.SENT, 10):
        monkeypatch.setattr(secrets, "SENT", sent)
        got = secrets.scan(table, rules, index).collect()
        assert multiset((r["doc_id"], tuple(map(tuple, r["found"]))) for r in got) == want
    assert secrets.scan(table, rules[3:5], index).where("size(found) > 0").count() == sum(bool(plain_spans(t, rules[3:5])) for _, t in rows)


def test_a_hundred_thousand_spans_in_one_text(spark):
    text = " ".join(["0123456789abcdef0123456789abcd"] * 100_000) + ' token="abcdef123456"'
    r = secrets.digest(secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r["n_hex"], r["n_assign"]) == (100_000, 1)
    assert r["spans"].endswith(f"hex:3099969:3099999,assign:3100000:{len(text) - 1}") or r["spans"].split(",")[-1].startswith("assign:3100000:")


@pytest.mark.parametrize("pattern", [r"a(?:bc|de)f{3}g?hij", r"(?i)\x41bc\d+def", r"[^a]xyz", r"x{2,}yzw|qqq[a-c]rst", r"(?=no)abc(?!d)\bdef$", r"a.cde*+fgh", r"[\]a-]bcd", r"tok\.en+?s{2}"])
def test_trigrams_are_mandatory(pattern):
    import random

    rng = random.Random(pattern)
    query = secrets.trigram_query(pattern)
    assert query, pattern
    pool = ["abcfffghij", "adefffhij", "AbC99def", "bxyz", "xxxyzw", "qqqbrst", "abc def", "aXcdeeefgh", "acdefgh", "]bcd", "-bcd", "abcd", "tok.ennss", "abc", "no"]
    for _ in range(300):
        text = "".join(rng.choice(pool) for _ in range(3))
        if re.search(pattern, text):
            assert any(all(g in text.lower() for g in s) for s in query), (text, query)


# -- quality


def spark_hash(spark, rows):
    """xxhash64 of words and of pairs of their hashes, from the engine, for a plain sum."""
    words = spark.createDataFrame([(w,) for w in rows], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    return {r["w"]: r["h"] for r in words}


def test_ratio_and_verdict_by_brute_force(spark, docs):  # noqa: F811
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = texts(docs)
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    own = spark_hash(spark, sorted({w for _, t in rows for w in WORD.findall(t)}) or ["x"])
    pairs = sorted({(own[a], own[b]) for _, t in rows for a, b in zip(WORD.findall(t), WORD.findall(t)[1:])})
    both = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(pairs or [(0, 0)], "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}

    def grams(t):
        h = [own[w] for w in WORD.findall(t)]
        return [x % quality.BUCKETS for x in [*h, *(both[p] for p in zip(h, h[1:]))]]

    raw, target = [1] * quality.BUCKETS, [1] * quality.BUCKETS
    for d, t in rows:
        for b in grams(t):
            raw[b] += 1
            target[b] += d in good
    level = math.log(sum(raw)) - math.log(sum(target))
    weight = [math.log(t) - math.log(r) + level for t, r in zip(target, raw)]
    want = {}
    for d, t in rows:
        g = grams(t)
        want.setdefault(d, []).append(sum(weight[b] for b in g) / max(len(g), 1))
    kept = 0
    for r in quality.rules(docs, labels).collect():
        ratio = min(want[r["doc_id"]], key=lambda x: abs(x - r["ratio"]))
        assert r["ratio"] == pytest.approx(ratio, abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["ratio"] >= quality.THRESHOLD)
        kept += r["kept"]
    assert kept or not rows


def test_clashing_names_pass_the_quality_stage(spark):
    text = " ".join(f"word{k}" for k in range(40))
    table = spark.createDataFrame([(1, text, "w", 5, "t")], "doc_id long, text string, __hl_words string, __hl_n int, `a.b` string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality.kept(table, labels).collect()] == [(1, text, "w", 5, "t")]


# -- row ids


def test_generated_rows_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "few.parquet")
    spark.createDataFrame([(k, f"alpha beta gamma delta epsilon zeta {k}") for k in range(3)], "doc_id long, text string").coalesce(1).write.parquet(path)
    few = spark.read.parquet(path)
    twice = few.withColumn("again", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("__hl_row", F.lit("mine"))
    assert simhash.first_of_each(twice).count() == 3
    assert simhash.first_of_each(few.union(few)).count() == 3
    assert common.filed(few.where("doc_id > 0")).count() == 2
    kept = simhash.first_of_each(few.withColumn("__hl_row", F.lit("mine")).withColumn("a.b", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "__hl_row", "a.b"] and kept.count() == 3
