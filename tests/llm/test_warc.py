import hashlib
from pathlib import Path

from inkmill.llm.warc import range_cuts, read_archives, sha1_base32, write_archives

ROWS = [
    (1, "http://a/é", "<p>one</p>"), (2, None, "<p>two</p>"), (3, "http://a/3", "<p>one</p>"), (4, "x\r\ny", None), (5, "u", ""),
    (5, "u", ""), (None, "n", "<p>one</p>"), (None, "n", "<p>none</p>"), (9, "z", "é" * 100_000), (7, "z", "é" * 100_000), (7, "y", "other"),
]


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        top = max((j for j, _, h in rows if (h or "") == (html or "") and j is not None), default=None)
        revisit = len(data) >= least and top is not None and i != top
        out.append((i, len(data), sha1_base32(data), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


def rows_of(spark, folder):
    got = read_archives(spark, folder)
    return sorted(
        map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str
    )


def digests(folder):
    return {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(folder).glob("shard-*")}


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, shard int")
    write_archives(pages, f"file://{tmp_path}/a")
    assert rows_of(spark, f"file://{tmp_path}/a") == brute(ROWS)
    write_archives(pages, f"file://{tmp_path}/b", min_revisit=20)
    assert rows_of(spark, f"file://{tmp_path}/b") == brute(ROWS, 20)
    whole = read_archives(spark, f"file://{tmp_path}/b", payloads=True).filter("record_type = 'response'").collect()
    texts = {(r.page_id, bytes(r.payload).decode()) for r in whole}
    assert (9, "é" * 100_000) in texts and (4, "") in texts


def test_files_roll_and_come_out_the_same(spark, tmp_path):
    import random

    rng = random.Random(1)
    rows = [(i * 5, f"http://h/{i}", "".join(rng.choices("abcdefghij", k=900))) for i in range(300)]
    names = []
    for name, parts in (("a", 3), ("b", 7)):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        files = write_archives(pages, f"file://{tmp_path}/{name}", file_bytes=6_000).collect()
        assert sum(f.records for f in files) == 300 and len(files) > 10
        assert {f.name: f.sha256 for f in files} == digests(tmp_path / name)
        assert all(f.bytes < 8_000 for f in files)
        assert not list((tmp_path / name).glob("tmp-*"))
        names.append(digests(tmp_path / name))
    assert names[0] == names[1]


def test_files_without_a_manifest_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame(ROWS[:3], "page_id long, url string, html string")
    write_archives(pages, f"file://{tmp_path}/a")
    (tmp_path / "a" / "tmp-left-over-shard-000000-00000.warc.gz").write_bytes(b"broken")
    assert len(rows_of(spark, f"file://{tmp_path}/a")) == 3


def test_empty(spark, tmp_path):
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    assert rows_of(spark, f"file://{tmp_path}/a") == []


def test_cuts_follow_the_weight(spark):
    rows = [(i, 1) for i in range(1000)] + [(10**12 + i, 1) for i in range(1000)]
    cuts = range_cuts(spark.createDataFrame(rows, "_id long, _weight long"), 8).tolist()
    edges = [-1, *cuts, 10**13]
    counts = [sum(a <= i < b for i, _ in rows) for a, b in zip(edges, edges[1:])]
    assert len(cuts) >= 6 and max(counts) <= 500 and sum(counts) == 2000
