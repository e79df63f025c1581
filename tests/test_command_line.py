import json

import pytest

from chatloom.__main__ import main


def lines(folder):
    return [json.loads(x) for p in folder.rglob("part*") if not p.name.endswith(".crc") for x in p.read_text().splitlines()]


def test_logs(spark, tmp_path):
    (tmp_path / "log.txt").write_text("a: GG\nb: gg\nc: gg!\nNightbot: hi\nd: what a run. it was long\n")
    main(["distill", "--input", str(tmp_path / "log.txt"), "--output", str(tmp_path / "d")])
    assert sorted(x["line"] for x in lines(tmp_path / "d")) == ["GG x3", "what a run. it was long"]
    main(["summarize", "--input", str(tmp_path / "log.txt"), "--output", str(tmp_path / "s"), "--no-drop-system-lines"])
    assert [x["window_id"] for x in lines(tmp_path / "s")] == ["log.txt"] and lines(tmp_path / "s")[0]["summary"]
    with pytest.raises(Exception):
        main(["distill", "--input", str(tmp_path / "log.txt"), "--output", str(tmp_path / "d")])


def test_pairs_and_splits(spark, tmp_path):
    rows = [{"id": f"A_{i}", "chat": f"u: number {i} is here", "summary": "one and the same target text for all"} for i in range(20)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)))
    main(["clean-pairs", "--input", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "c"), "--max-examples-per-target", "5"])
    assert len(lines(tmp_path / "c" / "part=train")) == 5 and len(lines(tmp_path / "c" / "part=val")) == 2
    main(["split", "--input", str(tmp_path / "p.jsonl"), "--output", str(tmp_path / "sp")])
    assert [len(lines(tmp_path / "sp" / f"part={k}")) for k in ("train", "val", "test")] == [17, 2, 1]
    rows = [{"input_text": "a: the plasma rake broke\nb: plasma rake again\nc: my plasma rake why\nd: what is going on"}, {"input_text": "short"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    main(["prep", "--input", str(tmp_path / "r.jsonl"), "--output", str(tmp_path / "pr")])
    assert [x["id"] for x in lines(tmp_path / "pr")] == ["row_1"]


def arrays(folder):
    return [x for p in folder.rglob("part*") if not p.name.endswith(".crc") for x in json.loads(p.read_text())]


def test_moments(spark, tmp_path, capsys):
    ms = [{"window_id": "1", "messages": ["[00:00:01] a: ocean man", "[00:00:02] b: ocean man"], "abstractive_summary": {"summary": "old one"}}] * 2 + [{"window_id": "2", "messages": ["[00:00:01] a: ocean man lol"]}] * 2
    (tmp_path / "A.json").write_text(json.dumps(ms))
    main(["rewrite", "--input", str(tmp_path / "A.json"), "--preview", "1"])
    out = arrays(tmp_path / "A_rewritten")
    assert len(out) == 4 and "old one" not in {x["abstractive_summary"]["summary"] for x in out}  # copies stay two rows each
    assert capsys.readouterr().out.count("\n- ") + 1 >= 1
    main(["retrieve", "--input", str(tmp_path / "A.json"), "--output", str(tmp_path / "n"), "--k", "1"])
    out = arrays(tmp_path / "n")
    assert [x["window_id"] for x in out] == ["2", "2"] and all(len(x["examples"]) == 1 for x in out)


def test_comparison_and_selected_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text("\n".join(f"u{i}: line {'abcdefghij'[i]} about the plasma rake. and more" for i in range(10)))
    (tmp_path / "pool.jsonl").write_text("\n".join(json.dumps({"chat": f"u: plasma rake {i}", "summary": f"about rake {i}"}) for i in range(5)))
    main(["compare", "--input", str(tmp_path / "log.txt"), "--output", str(tmp_path / "c"), "--pool", str(tmp_path / "pool.jsonl"), "--few-k", "2"])
    (doc,) = arrays(tmp_path / "c")
    assert doc["clean_stats"]["input_lines"] == 10 and doc["model"]["chunks"] == 1 and doc["model"]["latency_ms"] >= 0 and doc["ts"] > 0
    assert doc["few_prompt"].count("about rake") == 2 and doc["zero_prompt"].endswith("Summary:")
    main(["summarize", "--input", str(tmp_path / "log.txt"), "--output", str(tmp_path / "s"), "--max-selected-lines", "3", "--similarity-threshold", "0.99"])
    assert lines(tmp_path / "s")[0]["summary"]
