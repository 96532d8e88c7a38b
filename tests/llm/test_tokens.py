"""Token-id files: equal to plain encoding of whole texts, and random access."""

import glob
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from folioflow.llm import tokens

SCHEMA = "doc_id long, text string, start string, file string"


def brute(rows):
    tokenizer = Tokenizer.from_file(tokens.default_tokenizer())
    out, start = [], 0
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2]
        out.append((row[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["", " ", "a  b", " a b ", "x \n y\tz", "tab\t end ", "é ü\xa0 z", "it's we'll 123 <|endoftext|> x", "a" * 5000, "word " * 3000, "　 wide   line"]


@pytest.fixture
def rows():
    texts = [*ODD, None, "same text", "same text"]
    return [(i * 3 % 17 if i % 5 else None, t, "clash", None) for i, t in enumerate(texts)] + [(1, "again", "x", "y"), (1, "again", "x", "y")]


def test_matches_plain_encoding(spark, rows):
    for length in (8, 64, 2048):
        got = tokens.token_documents(spark.createDataFrame(rows, SCHEMA), length=length)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == brute(rows)


def test_memo_keeps_to_its_bound(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 7)
    encoder, tokenizer = tokens.Encoder(tokens.default_tokenizer(), 2), Tokenizer.from_file(tokens.default_tokenizer())
    texts = [*ODD, "The quick  brown fox\n\n jumps over it's lazy dog. " * 40, "one\ntwo three", "ab\n\ncd. e\nÉf!! g\nh.\nij \nk l\n m\n", "don't\ncan't stop'\n's x'", "ab.\u2028 cd x\u00b2. <|endoftext|> f"]
    for part in ([t] for t in texts):
        assert np.frombuffer(encoder(part)[0], encoder.dtype).tolist() == [*tokenizer.encode(part[0], add_special_tokens=False).ids, 2]
    for ids, text in zip(encoder(texts), texts, strict=True):
        assert np.frombuffer(ids, encoder.dtype).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, tokenizer = tokens.Encoder(path, 2), Tokenizer.from_file(path)
    assert np.frombuffer(encoder(["Two  words, here."])[0], encoder.dtype).tolist() == [*tokenizer.encode("Two  words, here.", add_special_tokens=False).ids, 2]


def test_empty_table(spark):
    assert tokens.token_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_random_access(spark, rows, tmp_path):
    manifest = tokens.write_sequences(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "out"), tokens.default_tokenizer(), length=16)
    total = manifest.agg({"n_tokens": "sum"}).first()[0]
    seen = 0
    for path in glob.glob(str(tmp_path / "out/*.arrow")):
        file = tokens.SequenceFile(path)
        for i in range(len(file)):
            ids, mask = file[i]
            assert len(ids) == 16 and not ids.flags.owndata and not mask.flags.owndata
            seen += int(np.unpackbits(mask).sum())
    assert seen == total


def test_whole_table(spark, sf):
    from folioflow.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op1_token_sequences"](spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows)
