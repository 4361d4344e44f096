import random
import struct
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from omniframe.llm import durable, token_store

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", "Hello, World!", "don't   stop", "a.b c,d", "É\u0301 naïve \u00a0 x", "12,345.67", "x" * 300, "<|endoftext|> mid a<|startoftext|>b", "日本語 text。", "\x1c \x85 odd", "it's. ok?", "e\u0301. f", "ΑΣ. Σ", "tab\tnew\nline", "😀!?..,", "İstanbul. ﬁ."]


TOK = Tokenizer.from_file(PATH)


def plain(text):
    return TOK.encode(text, add_special_tokens=False).ids + [2]


def ids_of(texts):
    ids, at = token_store.Encoder(PATH, 2).encode(pa.array(texts, pa.string()))
    return [ids[a:z].tolist() for a, z in zip(at, at[1:])]


def test_ids_are_those_of_whole_texts():
    assert ids_of([*TEXTS, None]) == [plain(t) for t in [*TEXTS, ""]]


PIECES = [*"aZtTsSdDmM'.,;:!?<|> 19\t\n\x0b\x1c_-", "\u0308", "\u0301", "\u0327", "\u00a0", "\u0085", "\u3000", "T\u0308", "É", "ΑΣ", "İ", "ß", "ﬁ", "K", "Å", "가", "ᄀ", "ᅡ", "日本", "😀", "'LL", "'Re", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "Hello", "WORLD", "½", "٣", "\u200d"]


def test_fuzzed_ids_are_those_of_whole_texts():
    rnd = random.Random(17)
    texts = ["".join(rnd.choices(PIECES, k=rnd.randrange(1, 14))) for _ in range(6000)]
    assert ids_of(texts) == [TOK.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, tok = token_store.Encoder(path, 50256), Tokenizer.from_file(path)
    ids, at = enc.encode(pa.array(TEXTS))
    assert not enc.by_words and [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [tok.encode(t, add_special_tokens=False).ids + [50256] for t in TEXTS]


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 50, 3000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        null = np.zeros(len(keys), bool)
        _, _, slot, _ = token_store.build_mph(keys, null)
        assert sorted(slot.tolist()) == list(range(len(keys)))


def test_shard_lookup():
    keys, null = np.array([0, -5, 7, 7, 9]), np.array([True, False, False, False, False])
    payload = np.array([[k, k + 1, 2] for k in range(5)], "<u2").tobytes()
    s = token_store.Shard(token_store.index(keys, null, np.full(5, 3), 2), pa.BufferReader(payload))
    assert [x.tolist() for x in s.get(None)] == [[0, 1, 2]]
    assert [x.tolist() for x in s.get(7)] == [[2, 3, 2], [3, 4, 2]]
    assert s.get(0) == [] and s.get(8) == [] and s.get(12345) == []
    with pytest.raises(ValueError):
        token_store.Shard(b"x" * 100, None)


def check(rows, got):
    """Rows with one key stand side by side in some order; everything else is settled."""
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = sorted((str(k), len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for k, i in ((k, plain(t or "")) for k, t in rows))
    assert sorted((str(k), n, c) for k, _, n, c in got) == want


@pytest.mark.parametrize("bytes_", [1 << 20, 200])
def test_round_trip(docs, monkeypatch, bytes_):
    monkeypatch.setattr(token_store, "SHARD_BYTES", bytes_)
    rows = [(k * 3 % 101, t) for k, t in enumerate(TEXTS * 4)] + [(200, None), (None, "none here"), (300, "same"), (300, "same")]
    rows += [(7, f"many rows share this id {k}") for k in range(60)] + [(None, f"and this {k}") for k in range(40)]
    rows += [(400, "long Text, " * 50_000), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    check(rows, token_store.store_and_read(docs(rows)).collect())
    assert token_store.store_and_read(docs([])).count() == 0


def test_a_worker_makes_one_encoder(tmp_path, monkeypatch):
    made = []

    class Counted(token_store.Encoder):
        def __init__(self, *args):
            made.append(args)
            super().__init__(*args)

    monkeypatch.setattr(token_store, "Encoder", Counted)
    monkeypatch.setattr(token_store, "_encoders", {}, raising=False)
    want = [plain(t) for t in TEXTS]
    for shard in range(3):
        monkeypatch.setattr("pyspark.TaskContext.get", lambda shard=shard: SimpleNamespace(partitionId=lambda: shard))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], names=["key", "text"])
        (row,) = token_store._write_shards(iter([batch]), str(tmp_path), PATH, 2)
        assert row.column("n_ids").to_pylist() == [sum(map(len, want))]
        got = np.fromfile(f"{token_store.shard_path(tmp_path, shard)}.ids", "<u2")
        assert got.tolist() == [i for t in want for i in t]
    assert len(made) == 1


def test_absent_keys_give_no_row(spark, docs):
    d, folder = docs([(1, "a"), (5, "b")]), durable.new_path(spark, "t")
    m = token_store.write(d, folder, PATH, 2)
    asked = spark.createDataFrame([(0,), (1,), (3,), (9,), (None,)], "doc_id long")
    assert [r.doc_id for r in token_store.read_back(m, folder, asked).collect()] == [1]
