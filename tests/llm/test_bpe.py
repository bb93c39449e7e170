import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from quadrel.llm import bpe

HARD = ["", " ", "  ", "a  b", "a \n b", "\n\n b", "x\n y <|endoftext|> z<|endoftext|>", "it's we'll  I'd\t\tfoo   ", "aaaa" * 700, "日本語 ñandú 😀😀 " * 9, " 's 't", "a　 b", "a\r\n \r\n b", "12½Ⅷ!!?? x", "\x00\x01 \x85 q", "ab" * 5000]


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "é", "'s", "'", "1", "!", "ñ", "日", "😀", "<|endoftext|>", "the", "\x85", "​", "_", "́", "Zebra"]
    return HARD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]


def test_same_as_the_library(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(9000, None, 1), (None, "null id", 1), (3, "a  b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(3)
    lib = library()
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.encode(docs, ["doc_id"], digests=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.encode(docs.limit(0), ["doc_id"]).count() == 0


def test_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")
    rows = bpe.encode(docs, ["doc_id"]).collect()
    source = dict(enumerate(texts()))
    assert all(r.decoded == source[r.doc_id] and r.n_tokens == len(r.ids) for r in rows)
    assert bpe.decode([list(r.ids) for r in rows]) == [source[r.doc_id] for r in rows]


def test_long_and_short_words_merge_alike():
    c = bpe.codec(bpe.read_spec())
    rng = random.Random(1)
    words = [bytes(rng.choice(b"thein ao") for _ in range(rng.randint(2, 64))) for _ in range(300)]
    for n in {len(w) for w in words}:
        same = [w for w in words if len(w) == n]
        assert c.merge_many(same) == [c.merge_one(w) for w in same]


def test_every_code_point_is_cut_as_the_library_does():
    c, cut = bpe.codec(bpe.read_spec()), library().pre_tokenizer.pre_tokenize_str
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p <= 0xDFFF]
    for k in range(0, len(points), 4096):
        text = "".join(f"a{x}b1{x}2!{x}! {x}'s{x}{x}  " for x in points[k : k + 4096])
        want = [text[a:b] for _, (a, b) in cut(text)]
        assert [w for p in c.pieces(text) for w in c.cut(p)] == want, hex(ord(points[k]))


def test_fuzzed_texts_are_as_the_library_says():
    c, lib, rng = bpe.codec(bpe.read_spec()), library(), random.Random(11)
    made = ["\U000191b2's", "\x1c\x1d a\x1e", " \x1f \u0558x"]
    for _ in range(4000):
        made.append("".join(rng.choice([" ", "'s", "a", "1", "!", "\n", chr(rng.randrange(0xD800)), chr(rng.randrange(0xE000, 0x110000))]) for _ in range(rng.randint(1, 12))))
    texts = [c.pieces_of(t) for t in made]
    c.learn(texts)
    for t, ps in zip(made, texts, strict=True):
        got = [int(x) for p in ps for x in c.chunks[p][0].split(",")]
        assert got == lib.encode(t, add_special_tokens=False).ids, ascii(t)


def test_the_cache_is_bounded(monkeypatch):
    c = bpe.Codec(bpe.read_spec())
    monkeypatch.setattr(bpe, "CACHED", 50)
    rng = random.Random(2)
    for _ in range(60):
        texts = [c.pieces_of(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20)) + " " + "x" * 1000 + str(rng.random()))]
        c.learn(texts)
        assert all(p in c.chunks for p in texts[0])
    assert len(c.chunks) < 120 and len(c.old_chunks) < 120 and sum(len(p) > bpe.LONG for p in [*c.chunks, *c.old_chunks]) <= 1


def test_files_that_ask_for_more_are_refused():
    import json

    import pytest

    spec = json.loads(bpe.read_spec())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(spec | change))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id bigint, text string, ids int, n_tokens int")
    out = bpe.encode(docs, ["text", "doc_id"]).collect()[0]
    assert (out.text, out.doc_id, out.decoded) == ("a b", 1, "a b")
