from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as c
from masar.llm import near_copies, packing, pii, quality, simhash
from tests.llm.test_decontaminate import slow_pairs
from tests.llm.test_near_copies import slow as near_groups
from tests.llm.test_pii import base


def test_each_stage_on_what_the_last_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    at = columns.index("text")
    # the same rows again, and rows with nulls
    rows += [rows[3], rows[3], tuple(None for _ in columns), tuple(None for _ in columns), tuple(None if k == "doc_id" else "a text of its own, seen nowhere else, of no id" if k == "text" else v for k, v in zip(columns, rows[5], strict=True))]
    now = spark.createDataFrame(rows, docs.schema)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")

    good = quality.classify(now, labels)
    want = Counter((r["doc_id"], r["predicted"]) for r in good.collect())
    kept = c.keep_good(spark, now, sf_dir)
    assert kept.columns == columns
    have = [tuple(r) for r in kept.collect()]
    assert Counter(r[0] for r in have) == Counter({i: n for (i, p), n in want.items() if p})
    assert 0 < len(have) < len(rows)

    now = spark.createDataFrame(have, docs.schema)
    stay = {}
    for r, g in zip(have, near_groups([(r[0], r[at], "") for r in have]), strict=True):
        stay[g] = min((x for x in (stay.get(g), r[0]) if x is not None), default=None)
    out = c.drop_near_duplicates(spark, now, sf_dir)
    assert out.columns == columns
    have = [tuple(r) for r in out.collect()]
    assert sorted(str(r[0]) for r in have) == sorted(map(str, stay.values()))

    now = spark.createDataFrame(have, docs.schema)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {k for k, _ in slow_pairs([(k, r[at]) for k, r in enumerate(have)], items)}
    clean = c.drop_contaminated(spark, now, sf_dir)
    assert clean.columns == columns
    have, before = [tuple(r) for r in clean.collect()], have
    assert sorted(map(str, have)) == sorted(str(r) for k, r in enumerate(before) if k not in bad)
    assert bad

    now = spark.createDataFrame(have, docs.schema)
    safe = c.redact_personal_data(spark, now, sf_dir)
    assert safe.columns == columns
    after = [tuple(r) for r in safe.collect()]
    assert sorted(str(r[0]) for r in after) == sorted(str(r[0]) for r in have)
    texts = {r[0]: r[at] for r in after}
    for r in have:
        if r[0] is not None:
            assert texts[r[0]] == r[at] or base(r[at]) or any(f"<{k.upper()}>" in texts[r[0]] for k in pii.KINDS)
            assert not base(texts[r[0]])

    packed = c.pack(spark, spark.createDataFrame(after, docs.schema), sf_dir).collect()
    assert Counter(str(r["doc_id"]) for r in packed if r["piece"] == 0) == Counter(str(r[0]) for r in after)
    assert sum(r["length"] for r in packed) == sum(len((r[at] or "").split()) for r in after)
    assert max(r["length"] for r in packed) <= packing.LONGEST


def test_clashing_columns_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    plain = docs
    for name in ("__base", "__wide", "__b", "__s", "__stats", "__fp", "stats", "sure_spans", "wide_spans", "base", "spans", "least_id", "fp", "Group", "key", "k", "node", "component", "component_id", "other_fp", "class", "label"):
        docs = docs.withColumn(name, F.lit(name))
    docs = docs.union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    plain = plain.union(plain.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in c.STAGES[:-1]:
        out, same = stage(spark, docs, sf_dir), stage(spark, plain, sf_dir)
        assert out.columns == docs.columns
        assert sorted(map(str, out.select(*plain.columns).collect())) == sorted(map(str, same.collect()))
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert c.pack(spark, docs, sf_dir).count() == c.pack(spark, plain, sf_dir).count()
    assert c.pack(spark, docs.limit(0), sf_dir).collect() == []


def test_run(spark, sf_dir):
    got = c.run(spark, sf_dir)
    assert {"doc_id", "batch", "bucket"} <= set(got.columns) and got.count() > 0


def test_near_duplicates_by_fingerprints(spark, sf_dir):
    """What operator 9 links goes, also where shingles alone wouldn't tell: repeated words make the fingerprints, different ones the sets."""
    texts = ["north gate open " * 50 + " ".join(f"{w}{k}" for k in range(20)) for w in "ab"]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate([*texts, "a text of its own that nothing else is like"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {0, 2}
    assert near_copies.one_of_each(docs).count() == 3
    assert sorted(r["doc_id"] for r in c.drop_near_duplicates(spark, docs, sf_dir).collect()) == [0, 2]
