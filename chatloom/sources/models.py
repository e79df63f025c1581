"""Pretrained models as generators and tokenizers, their storage, and training examples.

No model library is needed to import this: it is loaded in the worker that uses it,
once, and whatever offers ``from_pretrained`` will do. A model is named by an id or a
folder; loading tries the fast tokenizer first, then the slow one.

Defined cases: null or blank texts give no training example; longer ones are cut to
their budget; labels are padded with IGNORED, inputs with the tokenizer's pad id.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import text as T

#: Label of positions that don't count in the loss.
IGNORED = -100
LIBRARY = "transformers"


class Plain:
    """A pretrained tokenizer in the form that packing takes: ids without special tokens."""

    def __init__(self, tokenizer: Any):
        self.tokenizer = tokenizer

    def encode(self, text: str) -> list[int]:
        return list(self.tokenizer.encode(text, add_special_tokens=False))

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=True)


def load_tokenizer(model_id: str, allow_local: bool = True, library: str = LIBRARY) -> Any:
    """The tokenizer of a model; a folder only if ``allow_local``."""
    if not allow_local and os.path.exists(model_id):
        raise ValueError(f"{model_id} is a local path, not a model id")
    auto = importlib.import_module(library).AutoTokenizer
    try:
        return auto.from_pretrained(model_id, use_fast=True)
    except (ImportError, ValueError, OSError):
        return auto.from_pretrained(model_id, use_fast=False)


def tokenizer(model_id: str, allow_local: bool = True, library: str = LIBRARY) -> Callable[[], Plain]:
    """A factory for ``pack.chunked`` and ``pack.summarized``."""
    return lambda: Plain(load_tokenizer(model_id, allow_local, library))


def generator(model_id: str, allow_local: bool = True, library: str = LIBRARY, max_source: int = 1024, **options: Any) -> Callable[[], Callable[[list[str]], list[str]]]:
    """A factory for ``pack.summarized`` and ``pack.timed``: the model is loaded once a task; ``options`` go to its ``generate``."""

    def load() -> Callable[[list[str]], list[str]]:
        tok = load_tokenizer(model_id, allow_local, library)
        model = importlib.import_module(library).AutoModelForSeq2SeqLM.from_pretrained(model_id)
        model.eval()

        def generate(prompts: list[str]) -> list[str]:
            if not prompts:
                return []
            ids = tok(prompts, return_tensors="pt", padding=True, truncation=True, max_length=max_source)
            return [x.strip() for x in tok.batch_decode(model.generate(**ids, **options), skip_special_tokens=True)]

        return generate

    return load


def save(model: Any, tok: Any, path: str) -> None:
    """Write a model and its tokenizer to a new folder."""
    if os.path.exists(path):
        raise ValueError(f"{path} exists")
    model.save_pretrained(path)
    tok.save_pretrained(path)


def training_examples(pairs: DataFrame, tokenizer: Callable[[], Any], key: str = "pair_id", source: str = "chat", target: str = "summary", max_source: int = 1024, max_target: int = 64, prefix: str = "", pad_id: int = 0) -> DataFrame:
    """(key, input_ids, attention, labels) of every pair with both texts, padded to the budgets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer()
        for batch in it:
            out: list[list] = [[], [], []]
            for s, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x, y = tok.encode(prefix + s)[:max_source], tok.encode(t)[:max_target]
                for o, v in zip(out, (x + [pad_id] * (max_source - len(x)), [1] * len(x) + [0] * (max_source - len(x)), y + [IGNORED] * (max_target - len(y)))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.list_(pa.int32())) for o in out)], [key, "input_ids", "attention", "labels"])

    ok = pairs.select(key, source, target).where(T.nonblank(F.col(source)) & T.nonblank(F.col(target)))
    return ok.mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, input_ids array<int>, attention array<int>, labels array<int>")


def fine_tuned(examples: DataFrame, train: Callable[[str, str], Any], folder: str, model_folder: str, processes: int = 1, local: bool = True) -> Any:
    """Write the examples once as Parquet and run ``train(folder, model_folder)`` in ``processes`` training processes; needs torch."""
    examples.write.mode("error").parquet(folder)
    distributor = importlib.import_module("pyspark.ml.torch.distributor").TorchDistributor
    return distributor(num_processes=processes, local_mode=local, use_gpu=False).run(train, folder, model_folder)
