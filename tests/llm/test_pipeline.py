"""The pipeline's stages on the smallest tables, one by one against what they are to remove."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from breakwater.llm import common, decontaminate, simhash, toxicity

from ..conftest import SF
from .test_operators import fingerprint, roots


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs, _ = common.write_table(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = (x.collect() for x in seen["near_duplicates"])
    fps = {r.doc_id: fingerprint(r.text) for r in before}
    long = {r.doc_id: simhash.long_fingerprint(r.text) for r in before}
    apart = lambda a, b: int(np.bitwise_count((long[a] ^ long[b]).view(np.uint64)).sum())
    link = roots(fps, [(a, b) for a in fps for b in fps if a < b and (bin(fps[a] ^ fps[b]).count("1") <= simhash.RADIUS or apart(a, b) <= simhash.LONG_RADIUS)])
    want, kept = {d for d in fps if link[d] == d}, [r.doc_id for r in after]
    assert len(kept) == len(set(kept)) and want <= set(kept) and len(set(kept) - want) <= 2
    assert decontaminate.contaminated(seen["decontamination"][1], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    packed = {r.doc_id for r in seen["packing"][1].collect()}
    assert packed == {r.doc_id for r in seen["decontamination"][1].collect()}


def test_language_stage_drops_what_has_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, None, "s", 0), (10_001, "123 !!", None, "s", 0), (None, None, None, "s", 0)], docs.schema)
    left = corpus_pipeline.language(spark, docs.union(odd), SF)
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in docs.collect())


def test_stages_on_odd_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.orderBy("doc_id").first()
    odd = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "", None, "s", 0), (one.doc_id, *one[1:]), (None, one.text, "en", "s", 1), (10_002, "a " * 30_000, "en", "s", 60_000)], docs.schema)
    both = docs.union(odd)
    n = both.count()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, both, SF)
        rows = got.collect()
        assert name == "packing" or got.columns == docs.columns and 0 < len(rows) <= n
        ids = [r.doc_id for r in rows]
        if name == "near_duplicates":
            assert ids.count(one.doc_id) == 1 and None not in ids and 10_000 in ids and 10_001 not in ids
        elif name in ("toxicity", "decontamination"):
            assert None in ids and 10_000 in ids and 10_002 in ids
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_the_driver_holds_the_toxicity_sample_as_bits():
    """A row is packed in the task, and products with it unpack a few rows at a time."""
    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(77, size=int(rng.integers(0, 20)), replace=False).tolist()) for _ in range(1203)]
    x, v = toxicity.matrix(rows, 77), rng.normal(size=77)
    bits = np.frombuffer(b"".join(toxicity._bits(r, 77) for r in rows), np.uint8).reshape(len(rows), -1)
    assert bits.nbytes == 10 * len(rows)
    assert np.array_equal(np.unpackbits(bits, axis=1, count=77), x)
    assert np.array_equal(toxicity._times_bits(bits, v), toxicity._times(x, v))
