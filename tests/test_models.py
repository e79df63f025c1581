import sys
import types

import pytest

from chatloom.operators import pack
from chatloom.sources import models


class Tok:
    def __init__(self, fast):
        self.fast = fast

    def encode(self, text, add_special_tokens=True):
        return [len(w) for w in text.split()]

    def decode(self, ids, skip_special_tokens=True):
        return " ".join("x" * i for i in ids)

    def __call__(self, prompts, **_):
        return {"ids": prompts}

    def batch_decode(self, out, skip_special_tokens=True):
        return [f" {x} " for x in out]

    def save_pretrained(self, path):
        open(f"{path}/tok", "w").close()


class Model:
    def eval(self):
        return self

    def generate(self, ids, most=2):
        return [" ".join(p.split()[:most]) for p in ids]

    def save_pretrained(self, path):
        import os

        os.makedirs(path)


class AutoTokenizer:
    @staticmethod
    def from_pretrained(model_id, use_fast=True):
        if use_fast and model_id == "slow":
            raise ValueError("no fast one")
        return Tok(use_fast)


class AutoModel:
    @staticmethod
    def from_pretrained(model_id):
        return Model()


@pytest.fixture
def library(monkeypatch):
    m = types.ModuleType("fake_library")
    m.AutoTokenizer, m.AutoModelForSeq2SeqLM = AutoTokenizer, AutoModel
    monkeypatch.setitem(sys.modules, "fake_library", m)
    return "fake_library"


def test_loading(library, tmp_path):
    assert models.load_tokenizer("a/b", library=library).fast and not models.load_tokenizer("slow", library=library).fast
    with pytest.raises(ValueError):
        models.load_tokenizer(str(tmp_path), allow_local=False, library=library)
    gen = models.generator("a/b", library=library, most=1)()
    assert gen(["one two", "three four"]) == ["one", "three"] and gen([]) == []
    tok = models.tokenizer("a/b", library=library)()
    assert pack.chunks("aa bbb\nc", tok, 18) == ["aa bbb\nc"]
    models.save(Model(), Tok(True), str(tmp_path / "m"))
    assert (tmp_path / "m" / "tok").exists()
    with pytest.raises(ValueError):
        models.save(Model(), Tok(True), str(tmp_path / "m"))
    with pytest.raises(ModuleNotFoundError):
        models.generator("a/b", library="no_such_library")()


def test_training_examples(spark):
    df = spark.createDataFrame([(1, "aa b", "ccc"), (2, None, "x"), (3, " ", "x"), (4, "x", ""), (5, "a " * 50, "b " * 50)], "pair_id long, chat string, summary string")

    class Lengths:
        def encode(self, text):
            return [len(w) for w in text.split()]

    out = {r["pair_id"]: r for r in models.training_examples(df, Lengths, max_source=4, max_target=3, prefix="sum: ").collect()}
    assert set(out) == {1, 5}
    assert (out[1]["input_ids"], out[1]["attention"], out[1]["labels"]) == ([4, 2, 1, 0], [1, 1, 1, 0], [3, models.IGNORED, models.IGNORED])
    assert len(out[5]["input_ids"]) == 4 and out[5]["labels"] == [1, 1, 1]
    assert models.training_examples(df.limit(0), Lengths).count() == 0
