"""Ranked search, the as-of join and the Jaccard join against brute force, on real and on awkward rows."""

import collections
import datetime
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from heatline.llm import asof, jaccard, lexical

from .test_llm import awkward, docs, empty, groups, real, texts  # noqa: F401

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- ranked search


def plain_search(rows, items, k=10):
    held = [(d, collections.Counter(TERM.findall(lower(t or "")))) for d, t in rows]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i].update(TERM.findall(lower(t or "")))
    out = collections.Counter()
    for i, terms in asked.items():
        scored = []
        for d, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out.update((i, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scored)[:k], 1))
    return out


ITEMS = [(1, "alpha BETA ünï"), (1, "gamma"), (2, None), (3, ""), (None, "alpha"), (4, "the of and token one x"), (5, "日本 delta delta"), (6, "nowhere-to-be-found"), (7, "²_ A b C endoftext")]


@pytest.mark.parametrize("pairs,impacts", [(1 << 16, 1 << 20), (3, 50)])
def test_search(spark, docs, pairs, impacts):  # noqa: F811
    more = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id + 10 as item_id", "text")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").unionByName(more)
    if pairs < 9:
        items = items.where("item_id < 6")
    rows = [tuple(r) for r in items.collect()]
    got = collections.Counter(map(tuple, lexical.search(docs, items, pairs=pairs, impacts=impacts).collect()))
    assert got == plain_search(texts(docs), rows)


def test_search_without_items(spark, docs):  # noqa: F811
    assert lexical.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_long_texts_are_split_whole(monkeypatch):
    text = "Ab,cd " * 1000 + "é" * 50 + " 1x"
    want = [t.encode() for t in TERM.findall(lower(text))]
    monkeypatch.setattr(lexical, "PIECE", 64)
    assert [t for part in lexical.terms_of(text) for t in part] == want


def test_radix_sums():
    rng = np.random.default_rng(0)
    for top in (1, 1 << 15, 1 << 40, 1 << 63):
        keys = rng.integers(0, top, 5000).astype(np.uint64) if top > 1 else np.zeros(10, np.uint64)
        values = rng.integers(-5, 9, len(keys))
        k, v = lexical.summed(keys, values)
        want = collections.Counter()
        for a, b in zip(keys.tolist(), values.tolist()):
            want[a] += b
        assert dict(zip(k.tolist(), v.tolist())) == dict(want) and (np.diff(k.astype(object)) > 0).all()


# -- as-of join

H = 3_600_000_000
BASE = datetime.datetime(2024, 1, 1)


def crc(i):
    return zlib.crc32(str(i).encode())


def micros(ts):
    d = ts - datetime.datetime(1970, 1, 1)
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def used(ts, i):
    if ts is None:
        return None
    us = micros(ts)
    return us - us % (6 * H) if i is not None and crc(i) % 2 else us


def plain_asof(clicks, sales):
    orders = collections.defaultdict(list)
    for s, c, total, at in sales:
        us = used(at, s)
        cents = math.floor(100 * total + 0.5) if total is not None and abs(total) < 9e16 else None
        if c is None or us is None:
            continue
        for x in [s] + ([-1 - s] if s is not None and crc(s) % 3 else []):
            orders[c].append((us, cents, x))
    one = {}
    low = lambda v: (v is not None, v or 0)
    for i, ts, c in clicks:
        if i is not None:
            row = (used(ts, i), c)
            if i not in one or tuple(map(low, row)) > tuple(map(low, one[i])):
                one[i] = row
    out = collections.Counter()
    for i, (us, c) in one.items():
        near = [o for o in orders.get(c, []) if us is not None and c is not None and us - 720 * H <= o[0] <= us]
        if near:
            at = max(o[0] for o in near)
            tied = [o for o in near if o[0] == at]
            best = max(tied, key=lambda o: (low(o[1]), low(o[2])))
            out[i, c, us, best[2], us - at, best[1], len(tied)] += 1
        else:
            out[i, c, us, None, None, None, 0] += 1
    return out


def shop(spark, clicks, sales):
    c = spark.createDataFrame(clicks, "click_id long, ts timestamp_ntz, client_id long").selectExpr("*", "1 as cell", "'x' as us", "'y' as `order`")
    s = spark.createDataFrame(sales, "sale_id long, client_id long, total double, sold_at timestamp_ntz").selectExpr("*", "cast(sale_id % 6 as int) as priority", "1 as slice")
    return asof.clicks_of(c), asof.orders_of(s)


def awkward_shop(n, clients, days, seed):
    rng = random.Random(seed)
    when = lambda: None if rng.random() < 0.02 else BASE + datetime.timedelta(microseconds=rng.randrange(days * 86_400) * 1_000_000 + rng.choice([0, 0, 1, 999_999]))
    who = lambda: None if rng.random() < 0.02 else 7 if rng.random() < 0.5 else rng.randrange(clients)
    clicks = [(k, when(), who()) for k in range(n)]
    clicks += clicks[:20] + [(5, when(), who()), (None, when(), 7)]
    totals = [None, 0.0, 1.005, 12.34, 12.34, float("nan"), float("inf"), 1e300]
    sales = [(None if rng.random() < 0.02 else k, who(), rng.choice(totals), when()) for k in range(n // 2)]
    return clicks, sales + sales[:10]


@pytest.mark.parametrize("cell,slices,days", [(H, 4, 90), (H // 60, 1, 1), (24 * H, 1, 90), (720 * H, 2, 400)])
def test_asof(spark, cell, slices, days):
    clicks, sales = awkward_shop(600, 12, days, days)
    sales += [(10_000 + k, 7, 1.0, BASE + datetime.timedelta(seconds=k)) for k in range(0, 900, 3)]  # a busy hour
    clicks += [(20_000 + k, BASE + datetime.timedelta(seconds=2 * k), 7) for k in range(500)]
    c, s = shop(spark, clicks, sales)
    got = collections.Counter(map(tuple, asof.latest(c, s, cell_us=cell, slice_orders=slices).collect()))
    assert got == plain_asof(clicks, sales)


def test_asof_at_the_ends_of_the_tolerance(spark):
    at = BASE + datetime.timedelta(hours=1000)
    even = [k for k in range(200) if crc(k) % 2 == 0]
    clicks = [(even[0], at, 1), (even[1], at, 2), (even[2], at, 3), (even[3], at, 4), (even[4], datetime.datetime(1969, 12, 31, 23), 5)]
    hours = datetime.timedelta(hours=720)
    sales = [(even[0], 1, 1.0, at - hours), (even[1], 2, 1.0, at - hours - datetime.timedelta(microseconds=1)), (even[2], 3, 1.0, at), (even[3], 4, 1.0, at + datetime.timedelta(microseconds=1)), (even[4], 5, 2.0, datetime.datetime(1969, 12, 2))]
    c, s = shop(spark, clicks, sales)
    got = collections.Counter(map(tuple, asof.latest(c, s).collect()))
    assert got == plain_asof(clicks, sales)
    assert sum(r[3] is not None for r in got) == 3


def test_asof_of_empty_tables(spark):
    clicks, sales = awkward_shop(50, 5, 9, 1)
    c, s = shop(spark, clicks, sales)
    assert asof.latest(c.limit(0), s).count() == 0
    assert asof.latest(c, s.limit(0)).where("n_tied = 0 and sale_id is null").count() == 50


def test_asof_meets_few_orders_of_a_busy_client(spark):
    n = 20_000
    c = spark.range(n).selectExpr("id as click_id", "7L as client_id", "1704067200000000 + id * 36000 as ts_us")
    s = spark.range(n).selectExpr("7L as client_id", "1704067200000000 + id * 36000 as us", "id as sale_id", "id as total_cents")
    out = asof.latest(c, s)
    assert out.where("lag_us = 0 and sale_id = click_id and n_tied = 1").count() == n
    plan = out._jdf.queryExecution().executedPlan()
    made = re.findall(r"Cartesian|NestedLoop", plan.toString())
    assert not made


# -- Jaccard join


def three_words(text):
    w = lower(text or "").encode().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain_join(rows, num=90, den=100):
    sets = [three_words(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if g == a else g for g in label]
    least = {g: min((d for (d, _), h in zip(rows, label) if h == g and d is not None), default=None) for g in label}
    return collections.Counter((d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, label))


def test_jaccard(docs):  # noqa: F811
    assert collections.Counter(map(tuple, jaccard.join(docs).collect())) == plain_join(texts(docs))


def families(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    out = []
    for size in (11, 12, 30, 80, 300):
        for edits in (1, 1, 2, 3, 4, 8):
            base = [word() for _ in range(size)]
            out.append(" ".join(base))
            for _ in range(4):
                other = list(base)
                for _ in range(edits):
                    if rng.random() < 0.5:
                        other[rng.randrange(len(other))] = word()
                    else:
                        del other[rng.randrange(len(other))]
                out.append(" ".join(other))
    passage = [word() for _ in range(60)]  # many documents share it
    out += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(30)]
    copies = [word() for _ in range(150)]
    for _ in range(60):
        other = list(copies)
        for _ in range(rng.randrange(4)):
            other[rng.randrange(150)] = word()
        out.append(" ".join(other))
    line = [word() for _ in range(40)]
    out += [" ".join(line * 2), " ".join(line * 4)]
    return out


@pytest.mark.parametrize("levels,block,small", [(4, 2048, 16), (1, 2048, 4), (3, 5, 2), (4, 7, 1)])
def test_jaccard_loses_no_link(spark, tmp_path, levels, block, small):
    rows = list(enumerate(families()))
    path = str(tmp_path / "families.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = collections.Counter(map(tuple, jaccard.join(spark.read.parquet(path), levels=levels, block=block, small=small).collect()))
    assert got == plain_join(rows)


@pytest.mark.parametrize("ratio", [(60, 100), (80, 100), (1, 2)])
def test_other_ratios(spark, tmp_path, ratio):
    rows = list(enumerate(families(2)))[:120]
    path = str(tmp_path / "ratios.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = collections.Counter(map(tuple, jaccard.join(spark.read.parquet(path), ratio=ratio).collect()))
    assert got == plain_join(rows, *ratio)


def test_a_longer_prefix_leaves_out_the_most_crowded_shingles():
    level = lambda at, crowd: jaccard.chosen_level(np.array(at), np.array(crowd), 100, (90, 100))
    assert level([0, 11, 12, 13], [2, 9000, 9000, 9000]) == 1
    assert level([0, 1, 2, 11], [2, 5000, 2, 6000]) > 1
    assert level([0, 1], [5000, 5000]) == 3  # no node can share three of its two


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_shingles_of_a_column(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "TEXTS", size)
    column = ["a b c d", None, "", "  A  B\tC d ", "one", "é É x", "é é x", "\x1c\x85 y\u00a0z w v", "b a", "a b", "ab", "a b c d a b c d"] * 3
    sets = list(jaccard.shingle_sets(pa.array(["skip", *column])[1:]))
    want = [three_words(t) for t in column]
    assert [len(x) for x in sets] == [len(x) for x in want]
    assert all((set(a.tolist()) == set(b.tolist())) == (p == q) for a, p in zip(sets, want) for b, q in zip(sets, want))


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "clicks", "sales"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for module in (lexical, asof):
        df = module.query(spark, SF)
        cur = con.execute(module.SQL)
        at = [[x[0] for x in cur.description].index(c) for c in df.columns]
        assert collections.Counter(map(tuple, df.collect())) == collections.Counter(tuple(r[k] for k in at) for r in cur.fetchall())
