"""Byte-pair encoding by forced boundaries, and decoding.

A pair of neighbouring bytes that stands inside no vocabulary token can never
be merged over, so every such pair is a certain cut: the fragments between
cuts are encoded independently and their ids concatenated.  White space is
dropped by the vocabulary and is a cut anyhow, as is every border that the
pre-tokenizer's pattern draws.  The merges within a fragment are the
library's BPE model's, once for fragments that end a word and once for those
that don't.  Words repeat far more often than texts, so each worker process
keeps the ids of those that it has met lately, in two generations: when the
younger is full it becomes the older one, from which words met again come back,
so that frequent words outlast any number of rare ones.

The vocabulary file is read on the driver and broadcast (a few MB, checked);
tasks need no file.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain
from operator import add

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohort.llm.common import ship

ship(__name__)

MAX_FILE = 64 << 20
KEPT = 150_000  # encoded words and runs that make a generation (about 40 MB)
CHUNK = 4096  # runs looked up at a time; generations change between chunks
BATCH_SIZE = 1 << 20  # bytes or ids that leave a task at a time


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others for 256, 257, ... in order."""
    out, more = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


def load(path: str) -> dict:
    """What the tasks need of a tokenizers file: vocabulary, merge ranks, and which symbol pairs occur inside tokens.

    Only files of the kind this encoder is written for are taken: NFC, white
    space to one space, lower case, a splitting pattern, byte-level symbols
    and a suffix at the end of words.
    """
    with open(path, encoding="utf-8") as f:
        raw = f.read(MAX_FILE + 1)
    if len(raw) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    spec = json.loads(raw)
    steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    model = spec["model"]
    if (steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]
            or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]
            or spec["decoder"] is not None or not model["end_of_word_suffix"] or model["ignore_merges"]):
        raise ValueError(f"{path}: not a lower-casing byte-level vocabulary with word ends")
    suffix = model["end_of_word_suffix"]
    vocab = dict(model["vocab"])
    inside = set()
    for token in vocab:
        plain = token.removesuffix(suffix)
        inside.update(plain[k - 1:k + 1] for k in range(1, len(plain)))
    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens with options")
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {"vocab": vocab, "merges": [tuple(m) for m in merges], "inside": inside, "suffix": suffix,
            "pattern": split["pattern"]["Regex"], "added": added, "names": {i: t for t, i in (vocab | added).items()},
            "file": raw, "young": {}, "old": {}}


def fragments(word: str, inside: set) -> list[str]:
    """The word cut at every pair of symbols that no token holds."""
    if inside.issuperset(map(add, word, word[1:])):
        return [word]
    cuts = [k for k in range(1, len(word)) if word[k - 1:k + 1] not in inside]
    return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]


class Encoder:
    """Encodes whole texts; one for each task, over the worker's shared tables."""

    def __init__(self, tables: dict):
        import regex
        from tokenizers import models
        if "models" not in tables:  # once for each worker, which then needs the lists no more
            vocab, merges = tables.pop("vocab"), tables.pop("merges")
            tables["models"] = [models.BPE(vocab, merges, cache_capacity=0, **end)
                                for end in ({}, {"end_of_word_suffix": tables["suffix"]})]
        self.inner, self.final = tables["models"]
        self.t, self.symbols = tables, dict(enumerate(byte_symbols()))
        self.values = {c: b for b, c in self.symbols.items()}
        self.words = regex.compile(tables["pattern"]).findall
        # Latin letters with their accents and common punctuation; not U+0130, whose lower case is two characters
        self.plain = regex.compile("[\\x00-\\x1b\\x20-\\u012f\\u0131-\\u024f\\u2010-\\u2027\\u2030-\\u205e]*+").fullmatch
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(tables["added"]))) + ")")
        self.library = None

    def cut(self, text: str) -> list[str]:
        """The words of a text, by the vocabulary's own normalizer and pattern."""
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_str(self.t["file"])
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.values.__getitem__, p)).decode("utf-8", "surrogatepass") for p, _ in pieces]

    def run(self, run: str) -> tuple[int, ...]:
        """Ids of a run of Latin characters between white space, which no word crosses."""
        ids = self.t["old"].get(run)
        if ids is None:
            known, ids = self.t["young"].get, ()
            for w in self.words(run):
                ids += known(w) or self.word(w)
        if len(run) < 64:
            self.t["young"][run] = ids
        return ids

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word: its fragments' merges, one after the other; only the last fragment ends the word."""
        ids = self.t["old"].get(word)
        if ids is None:
            level = word.encode("utf-8", "replace").decode("latin-1").translate(self.symbols)
            *firsts, last = fragments(level, self.t["inside"])
            ids = tuple([t.id for t in self.final.tokenize(last)])
            if firsts:
                ids = tuple([t.id for piece in firsts for t in self.inner.tokenize(piece)]) + ids
        if len(word) < 64:
            self.t["young"][word] = ids
        return ids

    def turn(self) -> dict:
        """The younger generation, a new one if it is full."""
        if len(self.t["young"]) >= KEPT:
            self.t["old"], self.t["young"] = self.t["young"], {}
        return self.t["young"]

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.t["added"]:
                out.append(self.t["added"][part])
                continue
            composed = part if part.isascii() else unicodedata.normalize("NFC", part)
            if self.plain(composed):  # Python's rules agree there; elsewhere character tables differ between libraries
                one, pieces = self.run, composed.lower().split()
            else:
                one, pieces = self.word, self.cut(part)
            for k in range(0, len(pieces), CHUNK):
                known = self.turn().get
                out.extend(chain.from_iterable([known(w) or one(w) for w in pieces[k:k + CHUNK]]))
        return out


def shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(load(path))


def _slices(batch, sizes: np.ndarray) -> Iterator:
    """The batch in slices of about BATCH_SIZE, or of one row."""
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_SIZE, "right")))
        yield batch.slice(at, n)
        at += n


def _ids_column(ids: list[np.ndarray]):
    import pyarrow as pa
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))


def encode(docs: DataFrame, tables, decoded: bool = False) -> DataFrame:
    """``docs`` with the ids of each whole ``text`` in place of it, and on demand with what they decode to (see
    ``decode``), by the same worker; a null or empty text has none."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    names = [*(f.name for f in rest), "ids", "decoded"][:len(rest) + 1 + decoded]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        one = Encoder(tables.value)
        name = tables.value["names"].__getitem__
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(rest))), 0).to_numpy(zero_copy_only=False)
            for part in _slices(batch, sizes):
                lists = [one(t.as_py()) for t in part.column(len(rest))]
                out = [*part.columns[:len(rest)], _ids_column([np.array(x, dtype=np.int32) for x in lists])]
                if decoded:
                    out.append(pa.array([" ".join(map(name, x)) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    kinds = [*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return docs.select(*[f"`{f.name}`" for f in rest], "text").mapInArrow(run, T.StructType(kinds[:len(names)]))


def decode(rows: DataFrame, tables) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``: without a decoder in the file, the tokens' own strings joined by
    spaces.  Null ids give null; an id that the vocabulary lacks stands for nothing."""
    at = rows.columns.index("ids")
    names = [*rows.columns, "decoded"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        name = tables.value["names"].get
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for part in _slices(batch, sizes):
                texts = [None if not r.is_valid else " ".join(filter(None, map(name, r.as_py()))) for r in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def encoded(docs: DataFrame, path: str, *others: str) -> DataFrame:
    """(doc_id, others, ids, decoded) for every row of ``docs`` (doc_id, text, others)."""
    return encode(docs.select("doc_id", *others, "text"), shared(docs.sparkSession, path), decoded=True)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encoded`` returns."""
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def token_rows(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, decoded_sha256) for every row of ``docs``."""
    return encoded(docs, path, "lang", "source").select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
