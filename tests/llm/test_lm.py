"""The language model against exact seating distributions, an independent sampler and sums of probabilities."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from heatline.llm import lm


def stirling(d, most):
    """log S_d(c, t) by recurrence."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            out[c + 1] = np.logaddexp(np.concatenate([[-np.inf], out[c, :-1]]), np.where(t <= c, np.log(np.maximum(c - t * d, 1e-300)), -np.inf) + out[c])
    return out


def test_log_gamma():
    x = np.array([0.05, 0.5, 1.0, 2.5, 7.9, 8.0, 123.4, 1e7])
    assert lm.lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


@pytest.mark.parametrize(("c", "parent"), [(2, 0.9), (3, 0.02), (10, 0.9), (10, 0.02), (300, 0.9), (1500, 0.2), (1500, 0.02)])
def test_moves_leave_the_exact_distribution_of_tables(c, parent):
    d, others, copies = 0.6, 7, 2000
    opened = [math.log((1 + d * (others + k)) * parent) for k in range(1, c)]
    log = stirling(d, c)[c, 1:] + np.cumsum([0.0, *opened])
    want = np.exp(log - log.max())
    want /= want.sum()
    weight = lambda dish, k: ((1 + d * (others + k)) * parent, d * k)
    rng = np.random.default_rng(1)
    x = lm.Dishes(np.full(copies, c), np.ones(copies, np.int64), np.empty(0, np.int64))
    for k in range(60):
        x = lm.moved(x, weight, rng, k == 0)
    got = np.bincount(x.t, minlength=c + 1)[1:] / copies
    mean, spread = (want * np.arange(1, c + 1)).sum(), math.sqrt((want * np.arange(1, c + 1) ** 2).sum() - (want * np.arange(1, c + 1)).sum() ** 2)
    assert abs(x.t.mean() - mean) < 5 * spread / math.sqrt(copies) + 1e-9
    assert np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.05
    assert (np.diff(np.append(x.at, 0))[:-1][x.owners()[1:] == x.owners()[:-1]] > 0).all() and (x.at < c).all()


def test_resized_seatings_stay_whole():
    rng = np.random.default_rng(2)
    weight = lambda dish, k: (np.full(len(dish), 0.8), 0.4 * k)
    x = lm.moved(lm.Dishes(np.full(500, 40), np.ones(500, np.int64), np.empty(0, np.int64)), weight, rng)
    y = x.resized(rng.integers(1, 80, 500), weight, rng)
    assert (np.bincount(y.owners(), minlength=500) == y.t - 1).all() and (y.t <= y.c).all() and (y.at < y.c[y.owners()]).all()
    same = y.c >= x.c
    assert (y.t[same] >= x.t[same]).all()


CORPUS = [" ".join(random.Random(k).choices("a b c d e f".split(), [9, 6, 4, 2, 1, 1], k=random.Random(k).randint(0, 14))) for k in range(40)] + ["x x x x x x x", "a b a b a b c"] * 3


def one_bucket(texts, rounds):
    """Counts, states and model of a single bucket, through the stages' own functions."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([None] * len(texts), pa.int64()), "text": texts})
    grams = list(lm._grams(1)(iter([batch])))
    rows = [r for b in lm._merge(1)(iter(grams)) for r in b.to_pylist()]
    model, request = next(r for r in rows if r["part"] < 0), pa.table({"part": [0], "round": [0], "bucket": pa.array([0], pa.int32()), "blob": [next(r["a"] for r in rows if r["part"] == 0)]})
    n, v, pairs, one, two, lone, twice = model["stats"]
    level = lm.Level(n, v, pairs, (lm.discount(lone, twice), lm.discount(one, two)))
    states, deltas = [], []
    for r in range(rounds):
        asked = pa.concat_tables([request, *deltas])
        total = lm._sum_up(r)(asked)
        stream = [(0, lm.MODEL, -1, model["b"]), *([(0, lm.STATE, -1, states[-1])] if states else []), (0, lm.TOTALS, 0, total["blob"][0].as_py())]
        table = pa.RecordBatch.from_pydict({c: list(x) for c, x in zip(("bucket", "kind", "part", "blob"), zip(*stream))})
        out = [x for b in lm._sample(level, 1, r)(iter([table])) for x in b.to_pylist()]
        states.append(out[0]["blob"])
        level.parent.append(tuple(out[0]["stats"]))
        deltas.append(pa.table({"part": [0], "round": [r + 1], "bucket": pa.array([0], pa.int32()), "blob": [out[1]["blob"]]}))
    total = lm._sum_up(rounds)(pa.concat_tables([request, *deltas]))
    return level, lm.Model(level, model["a"], model["b"], states, [total["blob"][0].as_py()])


def hashed(w):
    return np.array([xxhash.xxh64_intdigest(w.encode() if isinstance(w, str) else w, 42)], "<u8")


def test_probabilities_sum_to_one():
    level, model = one_bucket(CORPUS, 3)
    words = [*"abcdefx", ""]
    assert level.v == len(words) and level.n == sum(len(t.split()) + 1 for t in CORPUS)
    for v in [*"abcdefx", lm.START]:
        context = lm.contexts_of(hashed(v))
        p = [model.look(hashed(w), context, np.zeros(1, np.int64), np.zeros(1, np.int64))[1][0] for w in [*words, "never seen"]]
        assert sum(p) == pytest.approx(1, abs=1e-9) and min(p) > 0


def plain_sampler(texts, d0, d1, sweeps, burn):
    """One customer at a time: context restaurants under a parent under a uniform base, strength 1. Averaged predictive probabilities."""
    rng = random.Random(4)
    tokens = [(v, w) for t in texts for v, w in zip(["<s>", *t.split()], [*t.split(), "</s>"])]
    vocabulary = sorted({w for _, w in tokens})
    base = 1 / (len(vocabulary) + 1)
    rooms = collections.defaultdict(lambda: collections.defaultdict(list))  # tables of each dish: customers
    d = lambda u: d0 if u == "" else d1

    def probability(u, w):
        room = rooms[u]
        c, t = sum(sum(x) for x in room.values()), sum(len(x) for x in room.values())
        own = room.get(w, [])
        return (max(0, sum(own) - d(u) * len(own)) + (1 + d(u) * t) * (base if u == "" else probability("", w))) / (1 + c)

    def sit(u, w):
        tables = rooms[u][w]
        t = sum(len(x) for x in rooms[u].values())
        new = (1 + d(u) * t) * (base if u == "" else probability("", w))
        at = rng.random() * (sum(x - d(u) for x in tables) + new)
        for k, x in enumerate(tables):
            at -= x - d(u)
            if at < 0:
                tables[k] += 1
                return
        tables.append(1)
        if u != "":
            sit("", w)

    def leave(u, w):
        tables = rooms[u][w]
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            del tables[k]
            if u != "":
                leave("", w)

    for v, w in tokens:
        sit("v" + v, w)
    mean = collections.Counter()
    for s in range(sweeps):
        for v, w in tokens:
            leave("v" + v, w)
            sit("v" + v, w)
        if s >= burn:
            for v in {v for v, _ in tokens}:
                for w in vocabulary:
                    mean[v, w] += probability("v" + v, w) / (sweeps - burn)
    return mean


def test_probabilities_agree_with_an_independent_sampler():
    level, model = one_bucket(CORPUS, 40)
    want = plain_sampler(CORPUS, *level.d, 260, 20)
    names = {"<s>": lm.START, "</s>": ""}
    total = worst = 0.0
    counts = collections.Counter((v, w) for t in CORPUS for v, w in zip(["<s>", *t.split()], [*t.split(), "</s>"]))
    for (v, w), p in want.items():
        got = model.look(hashed(names.get(w, w)), lm.contexts_of(hashed(names.get(v, v))), np.zeros(1, np.int64), np.zeros(1, np.int64))[1][0]
        worst = max(worst, abs(math.log(got / p)))
        total += counts[v, w] * math.log10(got / p)
    assert worst < 0.35 and abs(total) / level.n < 0.01


def test_f1_salts_of_one_bucket_may_meet_in_a_task(spark, monkeypatch):
    """A word that most tokens are: its bucket has 12 salts, some of which meet in one of 48 tasks. Scores are those of salts apart, and of buckets in groups."""
    docs = spark.createDataFrame([(k, "heat " * 400 + " ".join(f"w{(k * 7 + j) % 50}" for j in range(10))) for k in range(48)], "doc_id long, text string").repartitionByRange(16, "doc_id")
    heat = int(np.searchsorted(lm.edges(64, 24), hashed("heat"), side="right")[0])
    dealt = [r[0] for r in spark.range(12).select(F.hash(F.lit(heat), F.col("id").cast("int"))).collect()]
    apart = next(n for n in range(48, 1000) if len({h % n for h in dealt}) == 12)
    assert len({h % 48 for h in dealt}) < 12
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for tasks, groups in ((48, 96), (apart, 96), (48, 4)):
            monkeypatch.setattr(lm, "GROUPS", groups, raising=False)
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            got.append(sorted(tuple(r) for r in lm.score(docs, 24, 1).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[:5] for r in got[0]] == [(k, lm.held_out(k), 411, 411, sum(411 for j in range(48) if not lm.held_out(j))) for k in range(48)]
    for one, *others in zip(*got, strict=True):
        assert all(one[:5] == x[:5] and one[5:] == pytest.approx(x[5:], rel=1e-9) for x in others)
