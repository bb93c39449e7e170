"""Byte-level BPE: encoding with a segment tree over adjacent pair ranks, and decoding.

Each pre-token is a row of byte symbols. The leaves of its segment tree hold ``rank << 20 | position`` of the
pair that starts there, or NONE; inner nodes hold the minimum, so the root is the leftmost lowest-rank merge.
A merge rewrites three leaves and their paths to the root; it ends when the root is NONE. Pre-tokens of the
same tree width are merged side by side in numpy; those over WIDE symbols one at a time.

The tokenizer file says how texts are cut: a byte-level pre-tokenizer with its built-in pattern, and added tokens that are found as
they stand. A file that asks for anything else is refused. Letters and digits are those of Unicode 16.

A task keeps what it has encoded in a cache of two generations, bounded in entries and characters; pre-tokens over LONG characters
are not kept. Null and empty texts have no tokens and decode to ''. Whole texts are encoded, those without blanks too; rows, ties and
repeated rows are independent of each other; an empty table gives an empty result. Extra columns are dropped by the query and kept by
encode(), whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import lean
from .common import table

NONE = np.int64(1) << np.int64(62)
SHIFT = 20
WIDE = 64
#: Fixed value: the pre-tokenisation pattern of byte-level vocabularies, over shadows (see shadow()).
PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Code points that are letters (L) and numbers (N) from Unicode 16 on.
NEW_LETTERS = (
    "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 "
    "11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Entries, and characters, of one generation of a task's cache; longer pre-tokens are not kept.
CACHED, CACHED_CHARS, LONG = 120_000, 1 << 20, 256


def _ranges(listed: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (r.partition("-") for r in listed.split())]


class _Shadow(dict):
    """Code point -> code point for str.translate: ASCII stays (four separators count as marks), others by category."""

    new = [("X", _ranges(NEW_LETTERS)), ("0", _ranges(NEW_NUMBERS))]

    def __missing__(self, cp: int) -> int:
        kind = unicodedata.category(chr(cp))[0]
        found = next((c for c, rs in self.new if any(a <= cp <= b for a, b in rs)), None)
        if cp < 128:
            out = "!" if 0x1C <= cp <= 0x1F else chr(cp)
        elif found or kind in "LN":
            out = found or ("X" if kind == "L" else "0")
        else:
            out = "\t" if chr(cp).isspace() else "!"
        self[cp] = ord(out)
        return self[cp]


_SHADOW = _Shadow()


def shadow(text: str) -> str:
    """text with every letter outside ASCII as X, number as 0, white space as a tab and other character as !."""
    return text if text.isascii() and not _SEPARATORS.search(text) else text.translate(_SHADOW)


_SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


def _served(spec: dict) -> None:
    """Raise ValueError for what a tokenizer file may ask for and is not done here."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("normalizer", "post_processor") if spec.get(k) and spec[k].get("type") != "ByteLevel"]
    odd += [f"pre_tokenizer {before.get('type')}"] if before.get("type") != "ByteLevel" or not before.get("use_regex", True) else []
    odd += [f"model {model.get('type')}"] if model.get("type", "BPE") != "BPE" else []
    odd += [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [f"{k} of {t['content']}" for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip") if t.get(k)]
    if odd:
        raise ValueError(f"the tokenizer file asks for what is not served: {', '.join(odd)}")


class Codec:
    """The vocabulary, its pair ranks as an open-addressing table, and the merge loop."""

    def __init__(self, spec: str, digests: bool = True):
        spec = json.loads(spec)
        self.digests = digests
        _served(spec)
        model = spec["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[symbols[b]] for b in range(256)], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes.update({i: t.encode() for t, i in self.added.items()})
        self.size = max(self.size, *self.added.values(), 0) + 1
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.spaced = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self._hash_pairs(left * self.size + right)
        self.names = {i: str(i) for i in range(self.size)} if digests else {}
        self.words, self.old_words, self.chunks, self.old_chunks = {}, {}, {}, {}
        self.chars = {"words": 0, "chunks": 0}
        self.passing: tuple[list[str], list[str]] = [], []

    def _hash_pairs(self, keys: np.ndarray) -> None:
        bits = int(len(keys)).bit_length() + 3
        self.bits, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_rank = np.full(1 << bits, -1, np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[left[free]]  # of equal slots the last stays
            won = self.slot_key[at] == keys[left]
            self.slot_rank[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if it never merges."""
        key = a * self.size + b
        at = self._slot(key)
        found = np.where(self.slot_key[at] == key, self.slot_rank[at], -1)
        todo = np.flatnonzero((found < 0) & (self.slot_key[at] >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & self.mask
            seen = self.slot_key[at[todo]]
            hit = seen == key[todo]
            found[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return found

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of 2 to WIDE bytes, all merged side by side."""
        n = np.array([len(w) for w in words])
        m = int(n.max())
        leaves = 1 << int(m - 2).bit_length() if m > 2 else 1
        rows = len(words)
        flat = np.frombuffer(b"".join(w.ljust(m, b"\0") for w in words), np.uint8).reshape(rows, m)
        tok = self.first[flat]
        where = np.arange(m)
        inside = where < n[:, None]
        leaf = np.full((rows, leaves), NONE, np.int64)
        pair = inside[:, 1:]
        r = self.ranks(tok[:, :-1][pair], tok[:, 1:][pair])
        leaf[:, : m - 1][pair] = np.where(r < 0, NONE, r << SHIFT | np.broadcast_to(where[:-1], pair.shape)[pair])
        tree = np.full((rows, 2 * leaves), NONE, np.int64)
        tree[:, leaves:] = leaf
        for d in reversed(range(leaves.bit_length() - 1)):
            low, high = 1 << d, 2 << d
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
        nxt = np.broadcast_to(where + 1, (rows, m)).copy()
        prv = np.broadcast_to(where - 1, (rows, m)).copy()
        tree_, tok_, nxt_, prv_ = tree.reshape(-1), tok.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        alive_ = inside.reshape(-1).copy()
        width = 2 * leaves
        act = np.arange(rows)

        def put(rows_: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
            node = rows_ * width + leaves + pos
            tree_[node] = value
            at = leaves + pos
            base = rows_ * width
            for _ in range(leaves.bit_length() - 1):
                at = at >> 1
                kid = base + 2 * at
                tree_[base + at] = np.minimum(tree_[kid], tree_[kid + 1])

        while len(act):
            root = tree_[act * width + 1]
            live = root < NONE
            act, root = act[live], root[live]
            if not len(act):
                break
            p, rank = root & ((1 << SHIFT) - 1), root >> SHIFT
            base = act * m
            q = nxt_[base + p]
            new = self.merged[rank]
            tok_[base + p] = new
            alive_[base + q] = False
            after = nxt_[base + q]
            nxt_[base + p] = after
            has = after < n[act]
            prv_[(base + after)[has]] = p[has]
            pairs = q < leaves  # the last symbol of a row may have no leaf
            put(act[pairs], q[pairs], np.full(int(pairs.sum()), NONE, np.int64))
            right = np.full(len(act), NONE, np.int64)
            r = self.ranks(new[has], tok_[(base + after)[has]])
            right[has] = np.where(r < 0, NONE, r << SHIFT | p[has])
            put(act, p, right)
            before = prv_[base + p]
            has = before >= 0
            if has.any():
                r = self.ranks(tok_[(base + before)[has]], new[has])
                put(act[has], before[has], np.where(r < 0, NONE, r << SHIFT | before[has]))
        ids = tok_[alive_].tolist()
        ends = np.cumsum(alive_.reshape(rows, m).sum(1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_one(self, word: bytes) -> list[int]:
        """The same for one long pre-token: leaves, links and paths in plain lists."""
        n = len(word)
        tok = self.first[np.frombuffer(word, np.uint8)]
        r = self.ranks(tok[:-1], tok[1:])
        shift = max(SHIFT, n.bit_length())
        leaves = 1 << (n - 1).bit_length()
        tree = np.full(2 * leaves, NONE, np.int64)
        tree[leaves : leaves + n - 1] = np.where(r < 0, NONE, r << shift | np.arange(n - 1))
        d = leaves
        while d > 1:
            tree[d // 2 : d] = np.minimum(tree[d : 2 * d : 2], tree[d + 1 : 2 * d : 2])
            d //= 2
        tree, tok, none = tree.tolist(), tok.tolist(), int(NONE)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)
        key, rank, merged, size, mask = self.slot_key, self.slot_rank, self.merged, self.size, self.mask
        bits = int(self.bits)

        def pair(a: int, b: int, at: int) -> int:
            k = a * size + b
            s = (k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> bits
            while (x := key[s]) != k:
                if x < 0:
                    return none
                s = (s + 1) & mask
            return int(rank[s]) << shift | at

        def put(at: int, value: int) -> None:
            at += leaves
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                low = a if a < b else b
                if tree[at] == low:
                    break
                tree[at] = low

        while (root := tree[1]) < none:
            p = root & ((1 << shift) - 1)
            q = nxt[p]
            new = tok[p] = int(merged[root >> shift])
            alive[q] = 0
            after = nxt[p] = nxt[q]
            put(q, none)
            if after < n:
                prv[after] = p
                put(p, pair(new, tok[after], p))
            else:
                put(p, none)
            if (before := prv[p]) >= 0:
                put(before, pair(tok[before], new, before))
        return [t for t, a in zip(tok, alive, strict=True) if a]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct pre-tokens."""
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list[list[int]] = [[]] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            n = len(w)
            if n == 1:
                out[i] = [int(self.first[w[0]])]
            elif n > WIDE:
                out[i] = self.merge_one(w)
            elif n:
                groups.setdefault(max(2, (n - 2).bit_length()), []).append(i)
        for at in groups.values():
            for k in range(0, len(at), 20_000):
                part = at[k : k + 20_000]
                for i, ids in zip(part, self.merge_many([raw[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def pieces(self, text: str) -> list[str]:
        """Cut at each blank that a non-blank follows; pre-tokens never cross such a place."""
        parts = text.split(" ")
        if _LOOSE.search(text) is None:
            return [parts[0], *(" " + x for x in parts[1:])] if parts[0] else [" " + x for x in parts[1:]]
        out = [parts[0]]
        for x in parts[1:]:
            if x and not x[0].isspace():
                out.append(" " + x)
            else:
                out[-1] += " " + x
        return out if out[0] else out[1:]

    def cut(self, piece: str) -> list[str]:
        """The pre-tokens of a piece; a word, or a word and one ASCII mark after it, needs no pattern."""
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():
            return [piece]
        if body[-1:] in _ENDS and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return [piece[m.start() : m.end()] for m in PATTERN.finditer(shadow(piece))]

    def entry(self, ids: list[int]) -> tuple:
        """(ids, their number, bytes decoded from them); the ids as decimal text for digests, else as packed integers."""
        raw = self.bytes
        held = ",".join([self.names[i] for i in ids]) if self.digests else np.array(ids, np.int32).tobytes()
        return held, len(ids), b"".join([raw[i] for i in ids])

    def forget(self) -> None:
        """Empty the cache; the next task fills it within its first texts."""
        self.words, self.old_words, self.chunks, self.old_chunks = {}, {}, {}, {}
        self.chars = {"words": 0, "chunks": 0}
        self.passing = [], []

    def learn(self, texts: list[list[str]]) -> None:
        """Put the entries of the pieces of a batch into the cache.
        Of two generations the older is dropped when the younger is full; long pieces stay until the next batch."""
        for kind, long in zip(("words", "chunks"), self.passing, strict=True):
            for p in long:
                getattr(self, kind).pop(p, None)
            long.clear()
            if len(getattr(self, kind)) > CACHED or self.chars[kind] > CACHED_CHARS:
                setattr(self, f"old_{kind}", getattr(self, kind))
                setattr(self, kind, {})
                self.chars[kind] = 0
        known, old, words, old_words = self.chunks, self.old_chunks, self.words, self.old_words
        between = "," if self.digests else b""
        new = []
        for p in set(chain.from_iterable(texts)).difference(known):
            if (x := old.get(p)) is not None:
                known[p] = x
                self.chars["chunks"] += len(p)
            else:
                new.append((p, self.cut(p)))
        missing = []
        for w in {w for _, ws in new for w in ws}.difference(words):
            if (x := old_words.get(w)) is not None:
                words[w] = x
                self.chars["words"] += len(w)
            else:
                missing.append(w)
        for w, ids in zip(missing, self.encode_words(missing), strict=True):
            words[w] = self.entry(ids)
        for p, ws in new:
            if len(ws) == 1:
                known[p] = words[ws[0]]
            else:
                parts = [words[w] for w in ws]
                known[p] = (between.join([x[0] for x in parts]), sum([x[1] for x in parts]), b"".join([x[2] for x in parts]))
        for kind, long, added in (("words", self.passing[0], missing), ("chunks", self.passing[1], [p for p, _ in new])):
            self.chars[kind] += sum([len(p) for p in added if len(p) <= LONG])
            long += [p for p in added if len(p) > LONG]
        for t, i in self.added.items():
            known[_MARK + t] = self.entry([i])

    def pieces_of(self, text: str) -> list[str]:
        if self.split is None or not any(t in text for t in self.added):
            return self.pieces(self.prefixed(text))
        out: list[str] = []
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                out.append(_MARK + part)
            elif part:
                out += self.pieces(self.prefixed(part))
        return out

    def prefixed(self, part: str) -> str:
        return " " + part if self.spaced and not part[0].isspace() else part


#: A blank that another white space or the end follows.
_LOOSE = re.compile(r" (?:\s|$)")
#: Marks that form a pre-token of their own after a letter.
_ENDS = frozenset(".,;:!?")
#: Before an added token in a list of pieces; a lone surrogate, which no text holds.
_MARK = "\udc00"


@lru_cache(2)
def codec(spec: str, digests: bool = True) -> Codec:
    return Codec(spec, digests)


def read_spec(path: str | None = None) -> str:
    """The tokenizer file, read on the driver; it is as large as its vocabulary (here 50,257 entries)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _encoded(spec, columns: list[str], digests: bool):
    @lean
    def run(batches):
        c = codec(spec.value, digests)
        gc.disable()  # the cache is many tuples without cycles, which collections would walk again and again
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    yield encoded(c, batch.slice(i, 512))
        finally:
            c.forget()
            gc.enable()  # the worker goes on to other tasks

    def encoded(c: Codec, part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [c.pieces_of(t) if t else [] for t in part.column("text").to_pylist()]
        c.learn(texts)
        get = c.chunks
        rows = [[get[p] for p in ps] for ps in texts]
        cols = [part.column(k) for k in columns]
        cols.append(pa.array([sum([r[1] for r in rs]) for rs in rows], pa.int64()))
        if digests:
            cols.append(pa.array([hashlib.sha256(",".join([r[0] for r in rs]).encode()).hexdigest() for rs in rows], pa.string()))
            cols.append(pa.array([hashlib.sha256(b"".join([r[2] for r in rs]).decode("utf-8", "replace").encode()).hexdigest() for rs in rows], pa.string()))
            names = [*columns, "n_tokens", "ids_sha256", "decoded_sha256"]
        else:
            ids = [b"".join([r[0] for r in rs]) for rs in rows]
            offs = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(ids), np.int32))))
            cols.append(pa.array([b"".join([r[2] for r in rs]).decode("utf-8", "replace") for rs in rows], pa.string()))
            names = [*columns, "n_tokens", "ids", "decoded"]
        return pa.RecordBatch.from_arrays(cols, names)

    return run


def encode(docs: DataFrame, keep: list[str], digests: bool = False, path: str | None = None) -> DataFrame:
    """keep, n_tokens and either (ids, decoded) or the digests of both, for the column text."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)), "text")
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    extra = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    out = rows.mapInArrow(_encoded(spec, names, digests), f"{fields}n_tokens bigint, {extra}")
    return out.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), *out.columns[len(names) :])


def decode(lists: list[list[int]], path: str | None = None) -> list[str]:
    """Texts of id lists; bytes that are no UTF-8 become U+FFFD."""
    raw = codec(read_spec(path)).bytes
    return [b"".join(raw[i] for i in ids).decode("utf-8", "replace") for ids in lists]


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ["doc_id"], digests=True)
