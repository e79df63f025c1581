import json

import pytest

from chatloom.sources import io
from chatloom.streaming import live


def test_numbered_and_log(spark, tmp_path):
    p = tmp_path / "w1.txt"
    p.write_text("\n".join(f"u: line {i}" if i % 10 else " " for i in range(2000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = io.chat_log(spark, str(p))
        assert df.count() == 1800
        assert all(r["raw"] == f"u: line {r['line_no'] - 1}" for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "empty.txt").write_text(" \n")
    with pytest.raises(ValueError):
        io.chat_log(spark, str(tmp_path / "empty.txt"))


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"chat": "a", "summary": "b"}\n\n{"chat": 5, "summary": "b"}\n{"chat": " ", "summary": "b"}\n')
    assert [r["line_no"] for r in io.pairs(spark, str(good)).collect()] == [1]
    assert sorted(r["chat"] for r in io.pairs(spark, str(good), strict=False).collect()) == ["5", "a"]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"chat": "a", "summary": "b"}\n{oops\n')
    with pytest.raises(ValueError, match="line 2"):
        io.pairs(spark, str(bad))
    assert io.pairs(spark, str(bad), strict=False).count() == 1
    rows = tmp_path / "rows.jsonl"
    rows.write_text('{"input_text": "x"}\n\n{"id": "b", "input_text": "y"}\n{}\n')
    assert sorted(tuple(r) for r in io.prep_rows(spark, str(rows)).collect()) == [(1, "row_1", "x"), (2, "b", "y"), (3, "row_3", "")]


def test_moments_and_sinks(spark, tmp_path):
    p = tmp_path / "A.json"
    p.write_text(json.dumps([{"window_id": "w", "messages": ["é"], "extractive_summary": None}, {"messages": []}], ensure_ascii=False))
    m = io.moments(spark, str(p))
    assert [(r["file_name"], r["messages"]) for r in m.collect()] == [("A.json", ["é"]), ("A.json", [])]
    (tmp_path / "B.json").write_text("no json")
    with pytest.raises(ValueError):
        io.moments(spark, str(tmp_path / "B.json"))
    io.write_json_lines(m.coalesce(1), str(tmp_path / "out"))
    assert "é" in "".join(x.read_text() for x in (tmp_path / "out").glob("part*"))
    io.write_text(m.coalesce(1), "window_id", str(tmp_path / "txt"))
    io.write_splits(m.withColumnRenamed("window_id", "part"), "part", str(tmp_path / "splits"))
    assert (tmp_path / "splits" / "part=w").exists()
    assert json.loads(m.select(io.as_json("window_id", "messages").alias("j")).first()["j"])["messages"] == ["é"]


def test_answers_and_errors(spark):
    def client():
        def ask(p):
            if p == "b":
                raise TimeoutError("late")
            return p.upper()

        return ask

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    assert sorted(tuple(r) for r in io.answered(df, "k", "p", client).collect()) == [(1, "A", None), (2, None, "TimeoutError: late")]


def test_live_counts(spark, data):
    """A closed log is counted whole; an open one keeps its last windows back."""
    from chatloom.operators import distill

    schema = "window_id string, start timestamp, key string, n long"
    whole = live.run_once(spark, live.live_counts(live.log_stream(spark, data, closed=True)), schema, "live-test")
    still = live.run_once(spark, live.live_counts(live.log_stream(spark, data)), schema, "live-test")
    batch = spark.read.parquet(f"{data}/chat_log.parquet").where("sent_at IS NOT NULL AND raw IS NOT NULL")
    kept = distill.cleaned(batch.select("window_id", "line_no", "raw", "sent_at").dropDuplicates(["window_id", "line_no"]), keep=("sent_at",)).where("status = 'kept'").count()
    assert whole.agg({"n": "sum"}).first()[0] == kept
    assert still.exceptAll(whole).count() == 0 and still.count() < whole.count()


def test_json_arrays(spark, tmp_path):
    df = spark.createDataFrame([(i, "é" if i % 2 else None) for i in range(9)], "k long, t string").repartition(3)
    io.write_json_array(df, str(tmp_path / "a"))
    rows = [r for f in (tmp_path / "a").glob("part*") for r in json.loads(f.read_text())]
    assert sorted(r["k"] for r in rows) == list(range(9)) and {r["t"] for r in rows} == {"é", None}
    io.write_json_array(df.limit(0), str(tmp_path / "b"))
    assert all(json.loads(f.read_text() or "[]") == [] for f in (tmp_path / "b").glob("part*"))
    assert io.named_after("/x.y/log.txt", ".summary") == "/x.y/log.summary" and io.named_after("/x/dir/", "_a") == "/x/dir_a"
    p = tmp_path / "p.jsonl"
    p.write_text("\n".join(json.dumps({"chat": f"c{i}", "summary": "s"}) if i != 1 else "{" for i in range(5)))
    assert [r["chat"] for r in io.pairs(spark, str(p), strict=False, pool_limit=2).orderBy("line_no").collect()] == ["c0", "c2"]
