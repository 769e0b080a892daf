import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kohort.llm import bpe
from kohort.llm.common import table
from tests.llm.data import clashing, docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def want(library, rows):
    out = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in bpe.digests(bpe.encoded(df, PATH)).collect()), key=str)


def test_whole_table(spark, sf_dir, library):
    d = table(spark, sf_dir, "documents")
    assert got(d) == want(library, [(r.doc_id, r.text) for r in d.collect()])


def test_odd_texts(spark, library):
    rng = random.Random(2)
    texts = ["İSTANBUL ΑΣ ὈΔΥΣΣΕΎΣ", "½ ² Ⅷ x²", "e\u0301clair", "don't we'll I'M 'S!'s", "<|endoftext|>hi<|startoftext|><|ENDOFTEXT|>", "日本語 한국어 العربية",
             "😀👩‍👩‍👧", "a\x85b\x1cc d\u200be\u3000f", "x" * 20000, "\x00\x01\x7f", "ſ K Å ẞ ǅ", "…“q”—r", " ", "\n", "", None, None, "the " * 100000]
    for low, high in ((0, 0x250), (0x250, 0x3000), (32, 127)):
        texts += ["".join(chr(rng.randrange(low, high)) for _ in range(50)) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "twice"), (3, "twice"), (None, "none")]
    assert got(clashing(docs(spark, rows))) == want(library, rows)
    assert got(docs(spark, [])) == []


def test_decode_alone(spark, library):
    tables = bpe.shared(spark, PATH)
    rows = spark.createDataFrame([(1, [320, 2368]), (2, []), (3, None), (4, [-1, 320, 99999999])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(rows, tables).collect()}
    assert got == {1: library.decode([320, 2368], skip_special_tokens=False), 2: "", 3: None, 4: "a</w>"}
    whole = bpe.encode(docs(spark, [(1, "a cat"), (2, None)]).select("doc_id", "text"), tables)
    assert {r.doc_id: r.ids for r in whole.collect()} == {1: library.encode("a cat", add_special_tokens=False).ids, 2: []}


def test_cuts_are_forced(library):
    t = bpe.load(PATH)
    rng = random.Random(3)
    symbols = bpe.byte_symbols()
    plain = bpe.Encoder(t)
    for _ in range(300):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(30))
        level = "".join(symbols[b] for b in word.encode())
        assert "".join(bpe.fragments(level, t["inside"])) == level
        assert list(plain.word(word)) == [x.id for x in plain.final.tokenize(level)]


def test_other_vocabularies_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
