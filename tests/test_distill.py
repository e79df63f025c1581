import pytest
from pyspark.sql import functions as F

from chatloom.operators import distill
from chatloom.operators.distill import DistillOptions

CASES = [
    (["[00:00:01] ann: hello there"], ["hello there"], {}),
    (["Nightbot: hi all"], [], {"removed_system_lines": 1}),
    (["ann:"], [], {"removed_system_lines": 1}),
    (["ann: https://x.y/z"], [], {"removed_empty_lines": 1}),
    (["https://x.y/z"], ["//x.y/z"], {}),
    (["[00:01:02] hi"], ["01:02] hi"], {}),
    (["ann: I subscribed to him"], [], {"removed_system_lines": 1}),
    (["ann: Moments Badge - Tier 2"], [], {"removed_noise_lines": 1}),
    (["ann: x"], [], {"removed_empty_lines": 1}),
    (["ann: привет"], [], {"removed_empty_lines": 1}),
    (["ann: LUL lul LUL LUL"], ["LUL x4"], {"collapsed_token_flood_runs": 1}),
    (["ann: hi hi hi"], ["hi hi hi"], {}),
    (["ann: a b a b"], ["a a b b"], {"collapsed_token_flood_runs": 1}),
    (["ann: Ok ok Ok no"], ["ok ok ok no"], {"collapsed_token_flood_runs": 1}),
    (["ann: GG", "bob: gg", "cy: Gg!"], ["GG x3"], {"collapsed_duplicate_lines": 2, "collapsed_duplicate_groups": 1}),
    (["ann: GG", "bob: yo", "cy: gg"], ["GG", "GG", "yo"], {}),
    (["", None, "  "], [], None),
]
COUNTERS = ("removed_empty_lines", "removed_system_lines", "collapsed_duplicate_lines", "collapsed_duplicate_groups", "collapsed_token_flood_runs", "removed_noise_lines", "truncated_lines")


@pytest.fixture(scope="module")
def log(spark):
    rows = [(f"w{i}", j + 1, raw) for i, (lines, _, _) in enumerate(CASES) for j, raw in enumerate(lines)]
    return spark.createDataFrame([*rows, rows[0]], "window_id string, line_no long, raw string").withColumn("key", F.lit("clash"))


def test_golden_lines_and_counters(log):
    lines = distill.delivered(log)
    out = {}
    for r in distill.distilled(lines).orderBy("first_line", "copy").collect():
        out.setdefault(r["window_id"], []).append(r["line"])
    stats = {r["window_id"]: r.asDict() for r in distill.stats(lines).collect()}
    for i, (raw, want, counters) in enumerate(CASES):
        assert out.get(f"w{i}", []) == want, raw
        if counters is None:
            assert f"w{i}" not in stats
            continue
        assert {k: stats[f"w{i}"][k] for k in COUNTERS} == {k: counters.get(k, 0) for k in COUNTERS}, raw
        assert (stats[f"w{i}"]["input_lines"], stats[f"w{i}"]["output_lines"]) == (len(raw), len(want))


def test_conservation_and_partitioning(spark, data, rows):
    log = spark.read.parquet(f"{data}/chat_log.parquet")
    s = distill.stats(distill.delivered(log))
    assert s.where("input_lines <> output_lines + removed_empty_lines + removed_system_lines + removed_noise_lines + collapsed_duplicate_lines + truncated_lines").count() == 0
    assert rows(s) == rows(distill.stats(distill.delivered(log.repartition(7))))


def test_options(log, rows):
    lines = distill.delivered(log)
    assert distill.distilled(lines, DistillOptions(drop_system_lines=False)).where("window_id = 'w1'").count() == 1
    assert [r["line"] for r in distill.distilled(lines, DistillOptions(collapse_token_floods=False)).where("window_id = 'w10'").collect()] == ["LUL lul LUL LUL"]
    assert distill.distilled(lines, DistillOptions(collapse_duplicate_messages=False)).where("window_id = 'w14'").count() == 3
    cut = DistillOptions(max_messages=1)
    assert [r["line"] for r in distill.distilled(lines, cut).where("window_id = 'w15'").collect()] == ["GG"]
    assert distill.stats(lines, cut).where("window_id = 'w15'").first()["truncated_lines"] == 2


def test_empty_log(spark):
    empty = spark.createDataFrame([], "window_id string, line_no long, raw string")
    assert distill.stats(distill.delivered(empty)).count() == 0
    assert distill.texts(distill.delivered(empty)).count() == 0
