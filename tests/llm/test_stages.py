"""Every stage of the pipeline against a plain version, on its own input; the whole of it on awkward tables."""

import collections
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heatline.llm import common, pii, quality

from .test_llm import SF, awkward, five_words, groups, ids_of, multiset, real
from .test_native import plain


def bytes_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_each_stage_does_what_a_plain_version_does(spark):
    docs = real(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [tuple(r) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)

    verdict = {r["doc_id"]: r["kept"] for r in quality.rules(docs, labels).collect()}
    kept = common.written(stages["quality_rules"](spark, docs, SF), "q")
    rows = [r for r in rows if verdict[r[0]]]
    assert multiset(map(tuple, kept.collect())) == multiset(rows)

    sets = [five_words(bytes_lower(r[1] or "")) for r in rows]
    label = groups(sets)
    head = {}
    for r, g in zip(rows, label):
        head[g] = min(head.get(g, r[0]), r[0])
    alone = common.written(stages["near_duplicates"](spark, kept, SF), "n")
    rows = [r for r, g in zip(rows, label) if head[g] == r[0]]
    assert multiset(map(tuple, alone.collect())) == multiset(rows)

    masked = common.written(stages["personal_data"](spark, alone, SF), "p")
    rows = [(r[0], re.sub(pii.ANY, lambda m: plain(m[0], pii.TEST_KEY)[1], r[1], flags=re.A), *r[2:]) for r in rows]
    assert multiset(map(tuple, masked.collect())) == multiset(rows)

    packed = stages["packed_sequences"](spark, masked, SF).collect()
    want = collections.Counter()
    for r, ids in zip(rows, ids_of([r[1] for r in rows], 2)):
        cut = len(ids) % 1024 or min(len(ids), 1024)
        starts = [0, *range(cut, len(ids), 1024)]
        want.update((r[0], k, a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])))
    assert multiset((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in packed) == want


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_stages_on_awkward_and_empty_tables(spark, tmp_path, kind):
    docs = awkward(spark, tmp_path)
    docs = common.written(docs.where("false") if kind == "none" else docs.withColumn("__hl_row", F.lit(1)).withColumn("__hl_words", F.lit("w")).withColumn("a.b", F.lit(2)), "odd")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packed_sequences":
            assert out.columns == docs.columns, name
        docs = common.written(out, name) if name != "packed_sequences" else out
    assert docs.count() >= 0
