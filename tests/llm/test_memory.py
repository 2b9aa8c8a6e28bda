"""Caches are bounded by bytes and empty after a task; a tokenizer of another form goes through its library."""

import json
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from labelrank.llm import textops, tokenids

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello World, it's <|endoftext|> 42!!  Größe\tÀB\x0bc", "", "straße ﬁ İ " + "x" * 3000, "don't  stop... <b>bold</b> a<|startoftext|>b", "é  wide space"] + [f"word{chr(97 + i % 26)}{i} Ab{chr(98 + i % 20) * (i % 9)}, " * 3 for i in range(300)]


def library(path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda t: model.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("form", ["given", "cased", "no lower case", "other words"])
def test_ids_equal_the_library(form, tmp_path):
    path = PATH
    if form != "given":
        with open(PATH, encoding="utf-8") as f:
            file = json.load(f)
        if form == "cased":
            file["normalizer"] = None
        elif form == "no lower case":
            file["normalizer"]["normalizers"].pop()
        else:
            file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[^\s]+"
        path = str(tmp_path / "t.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(file, f)
    encoder, whole = tokenids._Encoder(path), library(path)
    assert encoder.by_model == (form == "given")
    for t in TEXTS:
        assert np.frombuffer(encoder.encode(t), np.uint32).tolist() == whole(t)


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE_BYTES", 20_000)
    encoder, whole = tokenids._Encoder(PATH), library(PATH)
    for t in TEXTS * 2 + [" ".join(TEXTS)]:
        assert np.frombuffer(encoder.encode(t), np.uint32).tolist() == whole(t)
        held = sum(sys.getsizeof(k) + sys.getsizeof(v) for c in (encoder.known, encoder.letters) for k, v in c.items())
        assert held < 2 * 20_000
    encoder.forget()
    assert not encoder.known and not encoder.letters and encoder.held == 0


def test_powers_of_a_long_text_are_not_kept(monkeypatch):
    monkeypatch.setattr(textops, "SLICE_BYTES", 100)
    powers = textops._Powers(np.uint64(3))
    assert powers.upto(1000).tolist() == [pow(3, k, 2**64) for k in range(1000)] and len(powers.all) <= 101
    assert powers.upto(50).tolist() == [3**k % 2**64 for k in range(50)] and len(powers.all) <= 101


def test_lean_keeps_the_rows():
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    assert [b.column(0)[0].as_py() for b in textops.lean(lambda x: iter(x))(iter(batches))] == [0, 1, 2]
