"""The stages against brute force, each on what its predecessor kept."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from inkmill.llm.decontam import normalised  # noqa: E402
from inkmill.llm.mixing import by_code_point, quotas  # noqa: E402
from inkmill.llm.quality import classified  # noqa: E402
from .test_decontam import slow_stretch  # noqa: E402
from .test_exact import brute as exact  # noqa: E402
from .test_near import brute as near  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    judged = classified(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    kept = {r.doc_id for r in judged if r.kept}
    assert 50 < len(kept) < len(rows)

    def pairs():
        return [(i, rows[i].text) for i in sorted(kept)]

    want = [set(kept)]
    kept = {r[0] for r in exact(pairs()) if r[3]}
    want.append(set(kept))
    kept = {r[0] for r in near(pairs(), 5) if r[3]}
    want.append(set(kept))
    items = [normalised((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{t[i : i + 6] for i in range(len(t) - 5)} for t in items]

    def leaks(text):
        text = normalised((text or "").encode())
        own = {text[i : i + 6] for i in range(len(text) - 5)}
        # A passage within a tenth of edits keeps at least this many of the item's 6-grams.
        return any(
            len(g & own) >= len(g) - 6 * (len(t) // 10) and slow_stretch(t, text)[0] <= len(t) // 10
            for t, g in zip(items, grams)
        )

    kept = {i for i in kept if not leaks(rows[i].text)}
    want.append(set(kept))
    frame = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want):
        frame = corpus_pipeline.written(stage(spark, frame, SF), "test")
        assert frame.columns == docs.columns, name
        assert sorted(r.doc_id for r in frame.collect()) == sorted(ids), name
    last = corpus_pipeline.STAGES[4][1](spark, frame, SF).collect()
    words = {i: len(rows[i].text.split()) for i in kept}
    names = sorted({rows[i].source for i in kept}, key=by_code_point)
    sizes = {s: sum(words[i] for i in kept if rows[i].source == s) for s in names}
    targets = quotas(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, sum(sizes.values()))
    largest = max(words.values())
    for s in names:
        taken = sum(r.taken for r in last if r.source == s)
        assert abs(taken - targets[s]) <= max(0.05 * targets[s], largest)
    assert all(r.taken == r.copies * words[r.doc_id] and 1 <= r.copies <= 3 for r in last)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame(
        [(None, "x y z", None, None, None), (5000, None, "en", "s", 0), (5000, None, "en", "s", 0), (5001, "", None, "s", 0)], docs.schema
    )
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and len({(r.doc_id, r.text) for r in rows}) == len(rows)
