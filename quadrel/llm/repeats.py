"""Repeats by winnowing and hashes: bytes covered by a string of LENGTH bytes that also starts elsewhere are removed.

This is in place of a logarithmic family of suffix arrays: entries are in the order of their hashes, not of their suffixes,
and no common prefixes are compared, as only matches of LENGTH bytes count. Winnowing names for every start
the GRAM-gram in its LENGTH bytes with the least hash (the leftmost of equals); it depends on those bytes alone, so equal
strings name equal grams at equal offsets. The runs of starts that name one gram are the entries,
ordered by (hash of the gram, hash of all bytes of the run's strings).

Entries are dealt out by gram, about TASK bytes of text a task. Each task keeps levels for its own batches, none across calls: every
batch is sorted and becomes a level; levels of equal size are merge-scanned for equal entries, and merged geometrically. Equal entries are
repeats as a whole. Entries that share the gram but not the whole run (at the edges of a repeat) are divided and go through further
indexes of the same kind, in parts of STEPS starts: parts with equal bytes are repeats as a whole, parts whose common bytes
(those that all their strings hold) meet nothing are none, the others are divided again, at last into single starts. The few bytes
around such entries are kept in a table of their own.

Two things keep a gram that a third of all rows share out of a single task. Equal entries of one input partition are found before
the shuffle and sent as one marker, so a passage costs one row per partition. A gram that one partition has with HOT or more
different runs is known to be undecided: one of these entries stands for it as a witness, and the rest pass on to the next index at once,
dealt out anywhere.

Rows get numbers in a table of deflated texts that is written first, so equal rows, also under one id, are rows of their own.
Strings are compared by two independent 64-bit hashes. Defined cases: null text is empty and has no repeats; texts under
LENGTH bytes stay whole; texts are read in pieces of PIECE bytes with an overlap, so long ones take no more memory there; strings never
cross rows; equal rows repeat each other, also under one id; overlapping repeats of a text with itself count; ties do not arise, as all places of a
string that repeats go; other columns are kept if asked for, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import U, lean, mix, Rolling
from .common import table, written

LENGTH, GRAM = 200, 48
_WINDOW = LENGTH - GRAM + 1
#: Starts in the parts that undecided entries are divided into, step by step.
STEPS = (8, 1)
#: Entries of a batch that becomes a level of an index family.
BATCH = 1 << 16
#: Bytes of text whose entries go to one task, and entries that go to one in later steps.
TASK, TASK_ENTRIES = 1 << 26, 1 << 20
#: Bytes of text that are indexed at once.
PIECE = 1 << 18
#: Rows, and bytes of deflated text, that are worked on at once.
ROWS, DEFLATED = 256, 1 << 18
#: Different runs of a gram in one input partition from which they pass on undecided.
HOT = 32
_LOW = U(0xFFFFFFFF)
#: Kinds of rows: an entry, with these bits, or a range already known to repeat.
KNOWN, MUST, PASSED, RANGE = 1, 2, 4, 8


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, run hash, row, first start, last start, start of the gram) of the runs of a piece; starts count from the piece."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.view(U), z.view(U), z, z, z, z
    grams = Rolling(data).every(GRAM)
    low = (grams >> U(32) << U(32)) | np.arange(len(grams), dtype=U)
    span = 1
    while 2 * span <= _WINDOW:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = _WINDOW - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    chosen = (low[:n] & _LOW).astype(np.int64)
    size = np.diff(offs)
    whole = np.ones(n, bool)
    for row in np.flatnonzero(size):  # no string crosses the end of its text
        whole[max(offs[row], offs[row + 1] - LENGTH + 1) : offs[row + 1]] = False
    start = np.flatnonzero(whole)
    chosen = chosen[start]
    edge = np.flatnonzero(np.diff(chosen)) + 1
    first = start[np.concatenate([[0], edge])] if len(start) else start
    last = start[np.concatenate([edge - 1, [len(start) - 1]])] if len(start) else start
    at = chosen[np.concatenate([[0], edge])] if len(start) else start
    run = mix(Rolling(data, 1).of(first, last + LENGTH) + (at - first).astype(U))
    return grams[at], run, np.searchsorted(offs, first, "right") - 1, first, last, at


def joined(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching ranges of each owner."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    lead = np.ones(len(owner), bool)
    lead[1:] = owner[1:] != owner[:-1]
    block = np.cumsum(lead) - 1
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + block * step)
    lead[1:] |= (start + block * step)[1:] > reach[:-1]
    first = np.flatnonzero(lead)
    return owner[first], start[first], np.maximum.reduceat(end, first)


def packed(start: np.ndarray, span: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """One number for the first start, the number of starts and the gram's distance from the first."""
    return start << 17 | span << 8 | gram


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 17, at >> 8 & 511, at & 255


class Family:
    """Levels of entries sorted by (g, c), unique in it; equal ones are reported as ranges when levels meet."""

    def __init__(self):
        self.levels: list[dict[str, np.ndarray]] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def scan(self, e: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Sort entries, report equal ones, keep one of each."""
        order = np.lexsort((e["c"], e["g"]))
        e = {k: v[order] for k, v in e.items()}
        new = np.ones(len(order), bool)
        new[1:] = (e["g"][1:] != e["g"][:-1]) | (e["c"][1:] != e["c"][:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        many = size > 1
        repeat = np.repeat(many, size)
        tell = repeat & (e["bits"] & KNOWN == 0)
        if tell.any():
            start, span, _ = unpacked(e["at"][tell])
            self.found.append((e["row"][tell], start, start + span + LENGTH - 1))
        kept = {k: v[first] for k, v in e.items()}
        if many.any():
            kept["bits"] = np.bitwise_or.reduceat(e["bits"], first) | np.where(many, KNOWN, 0).astype(np.int8)
        return kept

    def add(self, e: dict[str, np.ndarray]) -> None:
        level = self.scan(e)
        while self.levels and len(self.levels[-1]["g"]) <= 2 * len(level["g"]):
            level = self.scan(_both(self.levels.pop(), level))
        self.levels.append(level)

    def whole(self) -> dict[str, np.ndarray] | None:
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self.scan(_both(a, b)))
        return self.levels[0] if self.levels else None

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What has been found since the last call."""
        if not self.found:
            z = np.zeros(0, np.int64)
            return z, z, z
        parts, self.found = self.found, []
        return joined(*(np.concatenate([p[k] for p in parts]) for k in range(3)))


def _both(a: dict, b: dict) -> dict:
    return {k: np.concatenate([a[k], b[k]]) for k in a}


_NAMES = ("g", "c", "row", "at")
#: A RANGE has its start in at and its end in c.
_ROWS = "kind tinyint, g bigint, c bigint, row bigint, at bigint"


def _rows(kind: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, cols)], ["kind", *_NAMES])


def _scattered(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(row.view(U) * U(0x9E3779B97F4A7C15) ^ at.view(U)).view(np.int64)


def _ranges(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return _rows(np.full(len(owner), RANGE, np.int8), _scattered(owner, start), end, owner, start)


def _collapsed(e: dict[str, np.ndarray], hot: int):
    """Rows to be dealt out: what repeats within these entries, and one entry of each kind. Of the entries of a gram with
    hot or more runs (0: of none) the first is dealt out by the gram, the others anywhere."""
    own = Family()
    left = own.scan(e)
    if own.found:
        yield _ranges(*own.ranges())
    if hot:
        first = np.flatnonzero(np.append(True, left["g"][1:] != left["g"][:-1])) if len(left["g"]) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(left["g"])))
        many = np.repeat(size >= hot, size)
        if many.any():
            lead = np.zeros(len(many), bool)
            lead[first] = True
            left["bits"] = (left["bits"] | np.where(many, np.where(lead, MUST, PASSED), 0)).astype(np.int8)
            left["g"] = np.where(many & ~lead, _scattered(left["row"], left["at"]), left["g"])
    yield _rows(left["bits"], *(left[k] for k in _NAMES))


def _gathered(parts, size: int = 1 << 18):
    """Runs of at least size entries."""
    held, n = [], 0
    for e in parts:
        held.append(e)
        n += len(e["g"])
        if n >= size:
            yield {k: np.concatenate([x[k] for x in held]) for k in held[0]}
            held, n = [], 0
    if n:
        yield {k: np.concatenate([x[k] for x in held]) for k in held[0]}


def _sliced(batches, column: str = "packed"):
    """Slices of batches of at most ROWS rows, and of about DEFLATED bytes in column."""
    for batch in batches:
        size = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, min(i + ROWS, int(np.searchsorted(size, size[i] + DEFLATED, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j


def _windows(batch, piece: int):
    """(rows, places in the texts, bytes, offsets) of runs of about piece bytes; a longer text comes in several, with an overlap."""
    rows, at, data, n = [], [], [], 0
    for row, z in zip(batch.column("row").to_pylist(), batch.column("packed").to_pylist(), strict=True):
        raw = zlib.decompress(z)
        for a in range(0, len(raw) - LENGTH + 1, piece):
            part = raw[a : a + piece + LENGTH - 1]
            rows.append(row)
            at.append(a)
            data.append(part)
            n += len(part)
            if n >= piece:
                yield np.array(rows), np.array(at), np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
                rows, at, data, n = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(at), np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def _index_entries(hot: int, piece: int):
    def parts(batches):
        for batch in _sliced(batches):
            for key, place, data, offs in _windows(batch, piece):
                g, c, i, first, last, gram = runs(data, offs)
                if len(g):
                    at = packed(first - offs[i] + place[i], last - first + 1, gram - first)
                    yield {"g": g.view(np.int64), "c": c.view(np.int64), "row": key[i], "at": at, "bits": np.zeros(len(g), np.int8)}

    @lean
    def run(batches):
        for e in _gathered(parts(batches)):
            yield from _collapsed(e, hot)

    return run


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    offs = column.offsets.to_numpy()
    return offs - offs[0], column.values.slice(offs[0], offs[-1] - offs[0])


@lean
def _surroundings(batches):
    """Per row the bytes of its undecided entries: seg_at, where runs of bytes start in the text, seg_to, their ends in bytes."""
    for batch in _sliced(batches):
        offs, item = _lists(batch.column("todo"))
        at = item.field("at").to_numpy()
        seg_at, seg_to, data = [], [], []
        for r, z in enumerate(batch.column("packed").to_pylist()):
            raw = zlib.decompress(z)
            start, span, _ = unpacked(at[offs[r] : offs[r + 1]])
            _, a, b = joined(np.zeros(len(start), np.int64), start, start + span + LENGTH - 1)
            seg_at.append(a.tolist())
            seg_to.append(np.cumsum(b - a).tolist())
            data.append(b"".join([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]))
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("todo"), pa.array(seg_at, kind), pa.array(seg_to, kind), pa.array(data, pa.binary())], ["row", "todo", "seg_at", "seg_to", "data"])


def divided(start: np.ndarray, span: np.ndarray, gram: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """(entry, first start, last start, start of the common bytes, their end) of the parts of entries.

    Parts are counted from the gram, so equal strings fall into equal parts whatever their entries' ends are; the
    common bytes are those of a whole part even where an entry holds only some of its starts."""
    low, high = (gram - span + 1) // step, gram // step
    n = high - low + 1
    entry = np.repeat(np.arange(len(start)), n)
    q = low[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    zero = (start + gram)[entry]
    least, most = zero - (q * step + step - 1), zero - q * step
    first = np.maximum(least, start[entry])
    last = np.minimum(most, (start + span - 1)[entry])
    return entry, first, last, most, least + LENGTH


def _part_entries(step: int, hot: int):
    def parts(batches):
        for batch in _sliced(batches, "data"):
            key = batch.column("row").to_numpy(zero_copy_only=False)
            offs, item = _lists(batch.column("todo"))
            seg_offs, seg_at = _lists(batch.column("seg_at"))
            seg_at, seg_to = seg_at.to_numpy(), _lists(batch.column("seg_to"))[1].to_numpy()
            data = batch.column("data").to_pylist()
            base = np.concatenate([[0], np.cumsum([len(d) for d in data])])
            row = np.repeat(np.arange(len(key)), np.diff(offs))
            start, span, gram = unpacked(item.field("at").to_numpy())
            known = item.field("known").to_numpy(zero_copy_only=False)
            # place in the joined data of each text position: by the run of bytes that holds it
            seg_row = np.repeat(np.arange(len(key)), np.diff(seg_offs))
            seg_from = np.concatenate([[0], seg_to[:-1]])
            seg_from[seg_offs[:-1][np.diff(seg_offs) > 0]] = 0
            wide = 1 << 33
            seg = np.searchsorted(seg_row * wide + seg_at, row * wide + start, "right") - 1
            shift = base[row] + seg_from[seg] - seg_at[seg]
            flat = np.frombuffer(b"".join(data), np.uint8)
            hashed, common = Rolling(flat, 1), Rolling(flat)
            for k in range(0, len(row), BATCH):  # a few entries at a time, as each has many parts
                some = slice(k, k + BATCH)
                entry, first, last, least, until = divided(start[some], span[some], gram[some], step)
                move = shift[some][entry]
                c, g = hashed.of(first + move, last + LENGTH + move), common.of(least + move, until + move)
                at = packed(first, last - first + 1, (start + gram)[some][entry] - first)
                yield {"g": g.view(np.int64), "c": c.view(np.int64), "row": key[row[some][entry]], "at": at, "bits": np.where(known[some][entry], KNOWN, 0).astype(np.int8)}

    @lean
    def run(batches):
        for e in _gathered(parts(batches)):
            yield from _collapsed(e, hot)

    return run


def _family(edges: bool, size: int):
    """One index family over what is dealt to a task. edges: also give the entries that meet others under their g."""

    @lean
    def run(batches):
        index = Family()
        ready: list[pa.RecordBatch] = []

        def parts():
            for batch in batches:
                kind = batch.column("kind").to_numpy()
                cols = {k: batch.column(k).to_numpy() for k in _NAMES}
                done = (kind & (RANGE | PASSED)) != 0
                if done.any():
                    ready.append(_rows(kind[done], *(cols[k][done] for k in _NAMES)))
                yield {k: v[~done] for k, v in cols.items()} | {"bits": kind[~done]}

        for e in _gathered(parts(), size):
            index.add(e)
            yield from ready
            ready.clear()
            if index.found:
                yield _ranges(*index.ranges())
        yield from ready
        e = index.whole()
        if index.found:
            yield _ranges(*index.ranges())
        if edges and e is not None and len(e["g"]):
            same = e["g"][1:] == e["g"][:-1]
            meets = np.append(same, False) | np.insert(same, 0, False) | (e["bits"] & MUST != 0)
            yield _rows(e["bits"][meets], *(e[k][meets] for k in _NAMES))

    return run


def _deflated(columns: list[str]):
    @lean
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                z = [zlib.compress((t or "").encode("utf-8", "replace"), 3) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in columns), pa.array(z, pa.binary())], [*columns, "packed"])

    return run


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def deflated(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """A written table of row (a number), packed (the deflated text) and the columns keep under the names returned."""
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").alias("text"), *(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)))
    return written(rows.mapInArrow(_deflated(["row", *names]), f"{_fields(rows.drop('text'))}, packed binary")), names


def _cut(keep: list[str], texts: bool):
    @lean
    def run(batches):
        for batch in _sliced(batches):
            text, spans = batch.column("packed").to_pylist(), batch.column("spans").to_pylist()
            size, gone, count, sha, left = [], [], [], [], []
            for t, rs in zip(text, spans, strict=True):
                raw = zlib.decompress(t)
                rest, at, lost, n = [], 0, 0, 0
                if rs:
                    got = np.array([(r["start"], r["end"]) for r in rs], np.int64)
                    _, a, b = joined(np.zeros(len(got), np.int64), got[:, 0], got[:, 1])
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        rest.append(raw[at:x])
                        at, lost, n = y, lost + y - x, n + 1
                rest.append(raw[at:])
                kept = b"".join(rest)
                size.append(len(raw))
                gone.append(lost)
                count.append(n)
                if texts:
                    left.append(kept.decode("utf-8", "ignore"))
                else:
                    sha.append(hashlib.sha256(kept).hexdigest())
            cols = [batch.column(k) for k in keep] + [pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(left if texts else sha, pa.string())], [*keep, "n_bytes", "n_removed", "n_spans", "kept_text" if texts else "kept_sha256"])

    return run


def _todo(found: DataFrame) -> DataFrame:
    known = F.expr(f"kind & {KNOWN} <> 0").alias("known")
    return found.where(f"kind <> {RANGE}").groupBy("row").agg(F.collect_list(F.struct("at", known)).alias("todo"))


def _dealt(entries: DataFrame, tasks: int, edges: bool) -> DataFrame:
    """At least so many tasks; where the session has more partitions, Spark may join small ones."""
    many = tasks > int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (entries.repartition(tasks, "g") if many else entries.repartition("g")).mapInArrow(_family(edges, BATCH), _ROWS)


def repeated_ranges(rows: DataFrame, n_bytes: int, scratch: list[DataFrame]) -> DataFrame:
    """(row, start, end), byte ranges of rows (row bigint, packed) that repeat; they may overlap. n_bytes: of all texts;
    scratch: gets the written tables that the result reads."""
    found = [written(_dealt(rows.select("row", "packed").mapInArrow(_index_entries(HOT, PIECE), _ROWS), n_bytes // TASK, True))]
    todo = "array<struct<at: bigint, known: boolean>>"
    around = rows.select("row", "packed").join(_todo(found[0]), "row")
    around = written(around.mapInArrow(_surroundings, f"row bigint, todo {todo}, seg_at array<bigint>, seg_to array<bigint>, data binary"))
    held = around
    for step in STEPS:
        last = step == STEPS[-1]
        most = (LENGTH if step == STEPS[0] else STEPS[0]) // step + 1
        tasks = most * found[-1].where(f"kind <> {RANGE}").count() // TASK_ENTRIES
        part = _dealt(around.mapInArrow(_part_entries(step, 0 if last else HOT), _ROWS), tasks, not last)
        found.append(part if last else written(part))
        if not last:
            around = around.drop("todo").join(_todo(found[-1]), "row")
    scratch += [held, *found[:-1]]
    ranges = [f.where(f"kind = {RANGE}").select("row", F.col("at").alias("start"), F.col("c").alias("end")) for f in found]
    return reduce(DataFrame.unionByName, ranges)


def remove_repeats(docs: DataFrame, keep: list[str], texts: bool = True, scratch: list[DataFrame] | None = None) -> DataFrame:
    """keep, n_bytes, n_removed, n_spans and kept_text (kept_sha256 unless texts) of every row of docs.

    kept_text drops the rest of a character that a cut has split, and is '' for null; the digest is of the exact bytes.
    scratch gets the written tables that the result reads; they may be discarded when it has been written.
    """
    scratch = [] if scratch is None else scratch
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, names = deflated(docs, keep)
    scratch.append(rows)
    spans = repeated_ranges(rows, n_bytes, scratch).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    last = "kept_text string" if texts else "kept_sha256 string"
    kept = rows.join(spans, "row", "left").mapInArrow(_cut(names, texts), ", ".join(x for x in (_fields(rows.select(*names)), f"n_bytes bigint, n_removed bigint, n_spans bigint, {last}") if x))
    return kept.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), "n_bytes", "n_removed", "n_spans", last.split()[0])


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"], texts=False)
