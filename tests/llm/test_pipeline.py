"""The pipeline's stages, one after another, against brute force on each stage's own input."""

import zlib
from collections import Counter

import corpus_pipeline
from foliary.llm import langid, tokens
from tests.llm.test_exact_dedup import brute as exact
from tests.llm.test_jaccard import brute as near
from tests.llm.test_mixing_licenses import key, plan


def test_stages(spark, docs, tmp_path):
    names = docs.columns
    now, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, "/root/testdata/sf0.001")
        out.write.parquet(f"file://{tmp_path}/{k}")
        seen[name] = (now.collect(), spark.read.parquet(f"file://{tmp_path}/{k}").collect())
        now = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert k == 4 or now.columns == names
    before, after = seen["language_id"]
    assert {r.doc_id for r in before if any(c.isalpha() for c in r.text)} >= {r.doc_id for r in after} and len(after) >= 0.97 * len(before)
    told = langid.predict(docs.select("doc_id", "text"), langid.train(docs.select("doc_id", "text", "lang"), langid.learnable())).collect()
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in told if r.lang_pred != "und" and r.score >= 0.5)
    before, after = seen["exact_dedup"]
    assert sorted(r.doc_id for r in after) == sorted(d for d, _, _, kept, _ in exact(before) if kept)
    before, after = seen["ngram_jaccard"]
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in near(before, 5, 80, 100)})
    before, after = seen["mixing"]
    sums, budgets = plan(before, corpus_pipeline.MOST_REPEATS)
    want = Counter()
    for source, budget in budgets.items():
        at = 0
        for r in sorted((r for r in before if r.source == source), key=lambda r: key(r.doc_id)):
            want[r.doc_id] = budget // sums[source] + (at < budget % sums[source])
            at += len(r.text.split())
    assert Counter(r.doc_id for r in after) == want
    before, after = seen["packing"]
    ids = dict(zip([r.doc_id for r in before], tokens.encode([r.text for r in before], tokens.default_path(), 0), strict=True))
    lengths = Counter()
    for p in after:
        lengths[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].astype("<u4").tobytes())
    assert lengths == Counter({d: n * len(ids[d]) for d, n in Counter(r.doc_id for r in before).items()})


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_entry_lists_all_of_them():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)}
