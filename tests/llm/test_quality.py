import numpy as np

from inkmill.llm.quality import classified, fit, logistic

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.filter("doc_id % 4 = 0")
    some = docs.join(held, "doc_id", "left_semi").unionByName(docs.join(labels, "doc_id", "left_semi").filter("doc_id % 4 > 0"))
    judged = classified(some, labels.filter("doc_id % 4 > 0"))
    rows = judged.join(held, "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    toxic = [r.kept for r in rows if r.toxic == 1]
    poor = [r.kept for r in rows if r.quality == 0]
    assert len(toxic) > 80 and len(poor) > 100
    assert np.mean(clean) > 0.99 and np.mean(toxic) < 0.1 and np.mean(poor) < 0.03


def test_sites_shrink(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta"]
    docs, labels = [], []
    for i in range(400):
        host = "bad" if i % 4 == 0 else "good"
        docs.append((i, " ".join(rng.choice(words, 20)), host, "x"))
        labels.append((i, int(host == "good"), 0))
    docs.append((1000, "alpha beta", "new", "x"))
    rows = classified(
        spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    ).collect()
    effect = {r.doc_id: r.site_quality for r in rows}
    assert effect[0] < -0.3 < 0 < effect[1] and abs(effect[1000]) < min(-effect[0], effect[1])


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, True), (2, "", "a", "b", True), (2, "", "a", "b", True), (None, "x", "a", "b", True), (3, "long " * 50_000, "a", "b", True)],
        "doc_id long, text string, source string, lang string, kept boolean",
    )
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (2, 0, 1), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("doc_id = 1")):
        got = classified(docs, known).collect()
        assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "3", "None"]
        assert all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 and r.kept is not None for r in got)
    assert classified(docs.limit(0), labels).count() == 0


def test_logistic_separates():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = logistic(x, np.array([0, 0, 1, 1]))
    assert (x @ w[:1] + w[1] > 0).tolist() == [False, False, True, True]
    assert fit([], np.zeros(0, int), np.zeros(0, int)).score(b"text")[0] == 0.0
