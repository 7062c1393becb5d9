import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, documents
from tokenizers import Tokenizer

from docdelta.llm import token_store as ts


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 200_000, 37))])
def test_codes_round_trip(ids):
    r = ts.DacReader(ts.dac_encode(np.array(ids, np.uint32)))
    assert r.all().tolist() == ids
    for i in range(0, len(ids), 101):
        assert r[i] == ids[i]
    with pytest.raises(IndexError):
        r[len(ids)]


def test_random_access_around_rank_blocks():
    ids = np.random.default_rng(1).integers(0, 70_000, 3000).astype(np.uint32)
    r = ts.DacReader(ts.dac_encode(ids))
    assert [r[i] for i in range(len(ids))] == ids.tolist()


def brute(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    return out


def test_against_the_tokenizer(spark):
    rows = [*AWKWARD, (20, "a<|endoftext|>b don't  it'ś ́x"), (21, "\x1c\x85mid dle")]
    got = ts.token_files(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_empty_table(spark):
    assert ts.token_files(documents(spark, [])).collect() == []


def test_words_leave_and_come_back(monkeypatch):
    monkeypatch.setattr(ts, "CACHED_WORDS", 5)
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, words = Tokenizer.from_file(path), ts.Words(path)
    for i in range(60):
        text = f"One two{i % 7}, three's {i} Éa{i % 9}!"
        assert np.frombuffer(words.ids([text, text])[1], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
