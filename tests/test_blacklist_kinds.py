"""Only tokens that can bring a match are offered."""

from inkmill.operators import blacklist as bl


def test_no_sequence_tokens_without_the_ratio(spark):
    entry = "这里是一个很长的广告文本请访问我们的网站"
    entries = bl.read_entries(spark.createDataFrame([("1", entry, 1)], "id string, text string, ordinal int"))
    kept = [k for k, _ in bl._part_tokens(bl._codes(entry), False)]
    assert kept == [bl.ALIKE]
    norms = spark.createDataFrame([(entry[1:],), ("前" + entry,), (entry[:8] + "甲" + entry[9:],)], "norm string")
    found = bl.all_matches(norms, entries, sequence=False).select("norm", "method").collect()
    assert {tuple(r) for r in found} == {(entry[1:], "contained"), ("前" + entry, "contains"), (entry[:8] + "甲" + entry[9:], "fuzzy")}
