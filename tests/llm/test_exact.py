import hashlib

from pyspark.sql import functions as F

from inkmill.llm.exact import exact_groups

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(A_TO_Z), []).append(i)
    out = []
    for i, text in rows:
        own = groups[(text or "").translate(A_TO_Z)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((text or "").translate(A_TO_Z).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "same tExt "), (4, None), (5, ""), (6, "É"), (7, "é"), (7, "é"), (None, "SAME TEXT"),
    (None, "only here"), (8, "x" * 300 + "a"), (9, "X" * 300 + "b"), (10, "x" * 300 + "B"), (11, "long " * 60_000), (12, "LONG " * 60_000),
]


def test_groups(spark):
    docs = spark.createDataFrame([(i, t, "u", True) for i, t in ROWS], "doc_id long, text string, keep_id string, kept boolean")
    got = exact_groups(docs, hash_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


def test_texts_that_are_alone_are_not_read_whole(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_groups(docs)
    alone = {r.doc_id for r in got.filter(F.col("text_sha256").isNull()).collect()}
    assert {None, 3} <= alone and not alone & {1, 2, 4, 5, 8, 9, 10}
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {x[:3] for x in brute(ROWS)}


def test_empty(spark):
    assert exact_groups(spark.createDataFrame([], "doc_id long, text string"), hash_all=True).count() == 0


def test_no_python_on_the_executors(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exact_groups(docs, hash_all=True)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
