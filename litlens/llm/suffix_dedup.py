"""Removal of repeated byte strings across documents with hash-compared suffix sorting.

A byte goes when a string of `length` bytes that covers it also starts in a document with a smaller id. All strings of the
input are judged, in four steps:

1. Anchors. In every window of `length` bytes the k-gram with the smallest hash is an anchor (all of them, on ties), so equal
   windows have equal anchors at equal places. An anchor's context are the bytes that windows around it can reach. Per task
   only the smallest document of each (anchor, context) is sent on; in the others the whole context is a repeat.
2. Anchors that one document alone holds end here. Of equal contexts only the smallest document's is kept; the others' are
   repeats once their bytes are compared: each with those of the next smaller document that has the context, so that a text
   with very many copies is no hot key. Contexts in a row with one such document are compared as one run, in blocks. If any
   run differs, two contexts had one hash, and steps 1 and 2 start again with other hashes. A window reaches at least half of what it has besides its anchor to the left or to the right of it, so two
   contexts can share a window only if they agree on the half context on one side. The contexts that agree with one of
   another document there go to the sort, with the bytes of the windows that reach that side.
3. Sort. Contexts of one anchor and one half meet in a group, so an anchor that stands in very many surroundings is dealt to
   many groups. Windows whose hash no other document holds leave. The contexts are joined to one text; its suffixes at the
   window starts are sorted by a bottom-up merge sort. Two suffixes are compared by the hashes of their prefixes (polynomial, from prefix sums): a binary search finds how
   far they agree, the next byte decides. Neighbours that agree on `length` bytes are compared byte by byte, so a collision
   cannot remove anything, and make a run; within it, all but the smallest document's strings are repeats.
4. The repeats of each document are joined to maximal runs and cut out of its text.

Defined cases: null text is an empty text; texts shorter than `length` lose nothing; a null doc_id loses nothing and removes
nothing; rows of one doc_id are one id, so they never remove from each other, and each loses what a smaller id repeats (they are taken
to hold one text); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litlens.llm.common import checkpoint, discard, left_join_marked, partitions, read_table, semi_by_bitmap, small_batches
from litlens.llm.words import letters, mix, pieces, planes, powers, release, slices, unplanes

#: Length of an anchor's k-gram in bytes. Anchors of one task that are sent together.
GRAM, SENT = 18, 400_000
#: Bits of an anchor's hash, and of the hashes of its context and of the two half contexts (compared only under equal anchors).
ANCHOR_BITS, CONTEXT_BITS, SIDE_BITS = 48, 40, 12
#: Bytes of a block in which runs of equal contexts are compared.
BLOCK = 16_384
_LETTER = letters(lower=False)
_LARGEST = (1 << 63) - 1


def prefix_hashes(b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Sums from which hash_at() takes the polynomial hash of any substring; each seed gives other letters."""
    up, _ = powers(len(b) + 1)
    out = np.empty(len(b) + 1, np.uint64)
    out[0] = 0
    table = mix(_LETTER + np.uint64(seed)) if seed else _LETTER
    np.cumsum(table[b] * up[: len(b)], out=out[1:])
    return out


def hash_at(sums: np.ndarray, at: np.ndarray, n) -> np.ndarray:
    """Hash of the n bytes from each place."""
    _, down = powers(len(sums))
    return (sums[at + n] - sums[at]) * down[at]


def _sliding(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        a = op(a[:-step], a[step:])
        have += step
    return a


def anchors(texts: list[bytes], length: int, seed: int = 0, bits: int = CONTEXT_BITS) -> tuple[np.ndarray, ...]:
    """(text number, place in it, k-gram hash, context hash with the left and right half contexts' below) of every anchor.

    A context is cut where its text ends; the cuts are part of its hash.
    """
    joined = b"".join(texts)
    b = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    none = np.empty(0, np.int64)
    if len(b) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_hashes(b, seed)
    _, down = powers(len(b) + 1)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1]) | np.uint64(1)
    w = length - GRAM + 1
    low = _sliding(h, w, np.minimum)  # per window
    inside = np.zeros(len(low), bool)
    for e, n in zip(ends, sizes, strict=True):
        if n >= length:
            inside[e - n : e - length + 1] = True
    low = np.where(inside, low, np.uint64(0))
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, w, np.maximum)[: len(h)] == h)
    doc = np.searchsorted(ends, at, side="right")
    start, end = ends[doc] - sizes[doc], ends[doc]
    lo, hi = np.maximum(at - (length - GRAM), start), np.minimum(at + length, end)
    ctx = mix(hash_at(sums, lo, hi - lo) + (at - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (hi - at).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    half = (length - GRAM) // 2
    left, right = np.maximum(at - half, start), np.minimum(at + GRAM + half, end)
    sides = [mix(hash_at(sums, a, n) + n.astype(np.uint64)) >> np.uint64(64 - SIDE_BITS) for a, n in ((left, at + GRAM - left), (at, right - at))]
    ctx = ctx >> np.uint64(64 - bits)
    return doc, at - start, h[at], (ctx << np.uint64(2 * SIDE_BITS)) | (sides[0] << np.uint64(SIDE_BITS)) | sides[1]


def several(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether more than one document has the row's key."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        d = doc[order]
        mixed = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
        out[order] = np.repeat(mixed, np.diff(np.concatenate([head, [len(key)]])))
    return out


def _smallest_first(h: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by anchor, context, document and place; the last place of the next smaller document with the same context (-1:
    none, its document is the smallest)."""
    order = np.lexsort((pos, doc, ctx, h))
    h, ctx, doc, pos = h[order], ctx[order], doc[order], pos[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])]) if len(h) else np.empty(0, bool)
    if not len(h):
        return h, ctx, doc, pos, np.empty(0, np.int64)
    changes = new.copy()
    changes[1:] |= doc[1:] != doc[:-1]
    at = np.arange(len(h))
    before = np.maximum.accumulate(np.where(changes, at, 0)) - 1
    return h, ctx, doc, pos, np.where(before >= np.maximum.accumulate(np.where(new, at, 0)), before, -1)


def _rows(kind: int, doc: np.ndarray, pos: np.ndarray, anchor: np.ndarray, twin: np.ndarray, twin_pos: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(doc), kind, np.int8), "doc_id": doc.astype(np.int64), "pos": pos.astype(np.int32), "anchor": anchor.astype(np.int64), "twin": twin.astype(np.int64), "twin_pos": twin_pos.astype(np.int32)})


def find(docs: DataFrame, length: int, ranges: int, seed: int = 0, bits: int = CONTEXT_BITS) -> DataFrame:
    """(kind, doc_id, pos, anchor, twin, twin_pos): kind 1, the anchor's whole context has the hash of the one around twin_pos in
    the smaller document twin; else its windows that reach the half to the left (kind 2), to the right (3) or both (4) are to be
    sorted. `bits` is the width of a context's hash."""
    schema = pa.schema([("r", pa.int32()), *[(c, pa.binary()) for c in ("h", "ctx", "doc", "pos", "twin", "twin_pos")]])

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc, pos, h, ctx = (np.concatenate(x) for x in zip(*held, strict=True))
        h = h >> np.uint64(64 - ANCHOR_BITS)
        h, ctx, doc, pos, before = _smallest_first(h, ctx, doc, pos)
        # the smallest document may hold the same anchor and context twice; every place of it is kept
        larger, keep = before >= 0, before < 0
        twin = before[larger]
        rows = [(-1 - int(doc[larger][0]) % ranges, b"", b"", planes(doc[larger]), planes(pos[larger].astype(np.uint32)), planes(doc[twin]), planes(pos[twin].astype(np.uint32)))] if larger.any() else []
        h, ctx, doc, pos = h[keep], ctx[keep], doc[keep], pos[keep]
        cut = np.searchsorted(h, (np.arange(1, ranges, dtype=np.float64) * (2.0**ANCHOR_BITS / ranges)).astype(np.uint64))
        for r, (a, c, d, p) in enumerate(zip(np.split(h, cut), np.split(ctx, cut), np.split(doc, cut), np.split(pos, cut), strict=True)):
            if len(a):
                rows.append((r, planes(np.diff(a, prepend=np.uint64(0))), planes(c), planes(d), planes(p.astype(np.uint32)), b"", b""))
        for row in rows:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            texts, ids = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()], batch.column(0).to_numpy()
            for a, b in pieces(texts):
                doc, pos, h, ctx = anchors(texts[a:b], length, seed, bits)
                held.append((ids[a:b][doc], pos, h, ctx))
                size += len(doc)
                if size > SENT:
                    yield from send(held)
                    held, size = [], 0
        if size:
            yield from send(held)

    def meet(frame):
        release()
        r = int(frame["r"].iloc[0])
        doc = np.concatenate([unplanes(x, "<i8") for x in frame["doc"]])
        pos = np.concatenate([unplanes(x, "<u4") for x in frame["pos"]]).astype(np.int64)
        if r < 0:
            twins = [np.concatenate([unplanes(x, t) for x in frame[c]]) for c, t in (("twin", "<i8"), ("twin_pos", "<u4"))]
            return _rows(1, doc, pos, np.zeros(len(doc), np.int64), *twins)
        h = np.concatenate([np.cumsum(unplanes(x, "<u8")) for x in frame["h"]])
        ctx = np.concatenate([unplanes(x, "<u8") for x in frame["ctx"]])
        # anchors seen once need no sorting by the rest
        order = np.argsort(h, kind="stable")
        s = h[order]
        twin = np.zeros(len(s), bool)
        same = s[1:] == s[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        order = order[twin]
        h, ctx, doc, pos, before = _smallest_first(h[order], ctx[order], doc[order], pos[order])
        first, larger = np.flatnonzero(before < 0), np.flatnonzero(before >= 0)
        twin = before[larger]
        group = np.cumsum(np.concatenate([[False], h[first][1:] != h[first][:-1]])) if len(first) else first
        side = (1 << SIDE_BITS) - 1
        rest = ctx[first].astype(np.int64)
        left, right = (group << SIDE_BITS) | ((rest >> SIDE_BITS) & side), (group << SIDE_BITS) | (rest & side)
        by_left, by_right = several(left, doc[first]), several(right, doc[first])
        asked = [(kind, first[m]) for kind, m in ((2, by_left & ~by_right), (3, by_right & ~by_left), (4, by_left & by_right))]
        return pd.concat([_rows(1, doc[larger], pos[larger], np.zeros(len(larger), np.int64), doc[twin], pos[twin]), *(_rows(kind, doc[a], pos[a], h[a], doc[a], pos[a]) for kind, a in asked)])

    sent = docs.mapInArrow(scan, "r int, h binary, ctx binary, doc binary, pos binary, twin binary, twin_pos binary")
    return sent.groupBy("r").applyInPandas(meet, "kind byte, doc_id long, pos int, anchor long, twin long, twin_pos int")


def compare_contexts(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(doc_id, begin, end, twin, twin_begin, same): the runs of contexts of kind 1, cut at the blocks of their twins' texts, and
    whether they have their twins' bytes."""
    one = found.filter("kind = 1")
    wanted = one.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "twin", "twin_pos")).alias("places"))  # within one document
    some = semi_by_bitmap(docs, "doc_id", one.select("doc_id")).join(wanted, "doc_id")
    fields = pa.schema([(c, pa.int64()) for c in ("doc_id", "begin", "end", "twin", "twin_begin", "block")] + [("bytes", pa.binary())])
    blocks = pa.schema([("twin", pa.int64()), ("block", pa.int64()), ("twin_bytes", pa.binary())])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("places")
            row, flat = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
            pos, twin, twin_pos = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            shift = twin_pos - pos
            by = np.lexsort((pos, shift, twin, row))
            row, pos, twin, shift = row[by], pos[by], twin[by], shift[by]
            begin = np.maximum(pos - (length - GRAM), 0)
            begin = np.maximum(begin, -shift)
            end = np.minimum(pos + length, np.array([len(t) for t in texts], np.int64)[row])
            head = np.ones(len(row), bool)
            head[1:] = (row[1:] != row[:-1]) | (twin[1:] != twin[:-1]) | (shift[1:] != shift[:-1]) | (begin[1:] > end[:-1])
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(row)) - 1
            out = []
            for i, a, e, t, d in zip(row[first].tolist(), begin[first].tolist(), end[last].tolist(), twin[first].tolist(), shift[first].tolist(), strict=True):
                while a < e:
                    stop = min(e, ((a + d) // BLOCK + 1) * BLOCK - d)
                    out.append((ids[i], a, stop, t, a + d, (a + d) // BLOCK, texts[i][a:stop]))
                    a = stop
            cols = list(zip(*out, strict=True)) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                b = (text or "").encode("utf-8", "replace")
                out += [(doc, i, b[i * BLOCK : (i + 1) * BLOCK]) for i in range(-(-len(b) // BLOCK))]
            cols = list(zip(*out, strict=True)) if out else [[]] * len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, blocks, strict=True)], schema=blocks)

    mine = some.select("doc_id", "text", "places").mapInArrow(runs, "doc_id long, begin long, end long, twin long, twin_begin long, block long, bytes binary")
    theirs = semi_by_bitmap(docs, "doc_id", one.select(F.col("twin").alias("doc_id"))).select("doc_id", "text").mapInArrow(cut_up, "twin long, block long, twin_bytes binary")
    place = F.expr(f"substring(twin_bytes, cast(twin_begin % {BLOCK} as int) + 1, cast(end - begin as int))")
    return mine.join(theirs, ["twin", "block"], "left").select("doc_id", "begin", "end", "twin", "twin_begin", F.coalesce(place == F.col("bytes"), F.lit(False)).alias("same"))


def equal_contexts(docs: DataFrame, length: int, ranges: int, bits: int, tries: int = 5) -> tuple[DataFrame, DataFrame]:
    """find()'s table, and the compared runs of equal contexts; every run that is not the `same` is so in another of its rows."""
    for seed in range(tries):
        found = checkpoint(find(docs, length, ranges, seed, bits if seed == 0 else CONTEXT_BITS))
        runs = checkpoint(compare_contexts(docs, found, length))
        unlike = runs.filter("not same")
        # rows that repeat an id meet as pairs too: a run counts as compared if one of them agrees
        if unlike.isEmpty() or unlike.join(runs.filter("same"), ["doc_id", "begin", "end", "twin", "twin_begin"], "left_anti").isEmpty():
            return found, runs
        discard(found, runs)
    raise RuntimeError("contexts with equal hashes and different bytes after all tries")


def agreement(sums: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes, up to most, the suffixes at a and b share: binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = hash_at(sums, a, mid) == hash_at(sums, b, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def suffix_sort(text: np.ndarray, sums: np.ndarray, group: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes `at` within their groups (sorted), by their first `length` bytes: a bottom-up merge sort whose
    comparisons are hash-compared. All groups' merges of one width run together; an element's place in the merged run is its
    own plus the number of smaller ones in the other run, found by binary search. Two suffixes are first compared by their
    first eight bytes as a number and by the hashes of all `length` bytes; a search for their agreement is left to the others."""
    n = len(at)
    lead, whole = np.zeros(n, np.uint64), hash_at(sums, at, length)
    for i in range(8):
        lead = (lead << np.uint64(8)) | text[at + i]
    order = np.arange(n)
    first = np.searchsorted(group, group)
    size = np.searchsorted(group, group, side="right") - first
    place = np.arange(n) - first
    width, widest = 1, int(size.max(initial=0))
    while width < widest:
        run = place // width
        other = run ^ 1
        lo = np.minimum(other * width, size)
        hi = np.minimum(lo + width, size)
        base = lo.copy()
        todo = np.flatnonzero(lo < hi)
        left_run = run % 2 == 0
        while len(todo):
            mid = (lo[todo] + hi[todo]) // 2
            a, b = order[todo], order[first[todo] + mid]
            # stable: of equal suffixes the left run's come first
            goes_before = np.where(whole[a] == whole[b], ~left_run[todo], lead[b] < lead[a])
            close = np.flatnonzero((lead[a] == lead[b]) & (whole[a] != whole[b]))
            if len(close):
                x, y = at[a[close]], at[b[close]]
                k = agreement(sums, x, y, np.full(len(close), length - 1))
                goes_before[close] = text[y + k] < text[x + k]
            lo[todo] = np.where(goes_before, mid + 1, lo[todo])
            hi[todo] = np.where(goes_before, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        target = first + np.minimum(run, other) * width + (place - run * width) + (lo - base)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    return order


def repeats(frame: pd.DataFrame, length: int) -> pd.DataFrame:
    """(doc_id, begin, end) in bytes: the repeated strings among contexts (part, doc_id, begin, reach, bytes)."""
    release()
    frame = frame.sort_values(["part", "doc_id", "begin"], kind="stable")
    chunks = frame["bytes"].tolist()
    text = np.frombuffer(b"".join(chunks) + bytes(length), np.uint8)
    sums = prefix_hashes(text)
    size = np.array([len(c) for c in chunks], np.int64)
    begin = np.cumsum(size) - size
    windows = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(size)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    # windows of one part at one distance from the anchor are candidates for equality
    reach = frame["reach"].to_numpy(np.int64)
    part = np.cumsum(np.diff(frame["part"].to_numpy(np.int64), prepend=frame["part"].iloc[0]) != 0)
    key = part[owner] * (2 * length) + (offset - reach[owner] + length)
    twin = several(mix(hash_at(sums, begin[owner] + offset, length) + key.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), frame["doc_id"].to_numpy(np.int64)[owner])
    owner, offset, key = owner[twin], offset[twin], key[twin]
    by = np.argsort(key, kind="stable")
    owner, offset, key = owner[by], offset[by], key[by]
    at = begin[owner] + offset
    order = suffix_sort(text, sums, key, at, length)
    owner, offset, at = owner[order], offset[order], at[order]
    n = len(at)
    if not n:
        return pd.DataFrame({"doc_id": [], "begin": [], "end": []}).astype("int64")
    equal = np.zeros(n, bool)
    near = np.flatnonzero(key[1:] == key[:-1]) + 1
    near = near[hash_at(sums, at[near], length) == hash_at(sums, at[near - 1], length)]
    for a in range(0, len(near), 50_000):
        m = near[a : a + 50_000]
        grid = np.arange(length)
        equal[m] = (text[at[m, None] + grid] == text[at[m - 1, None] + grid]).all(1)
    run = np.cumsum(~equal) - 1
    doc = frame["doc_id"].to_numpy(np.int64)[owner]
    low = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, run, doc)
    hit = doc > low[run]
    start = frame["begin"].to_numpy(np.int64)[owner] + offset
    out = pd.DataFrame({"o": owner[hit], "doc_id": doc[hit], "begin": start[hit]}).sort_values(["o", "begin"])
    # neighbouring windows of a context as one run
    gap = (out["o"].diff() != 0) | (out["begin"].diff() > length)
    return out.groupby(gap.cumsum()).agg(doc_id=("doc_id", "first"), begin=("begin", "min"), end=("begin", "max")).assign(end=lambda x: x["end"] + length).reset_index(drop=True)


def sort_contexts(docs: DataFrame, asked: DataFrame, length: int, ranges: int) -> DataFrame:
    """(doc_id, begin, end) of the repeats that the sort finds among the asked-for contexts."""
    wanted = asked.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "anchor", "kind")).alias("places"))  # within one document
    some = semi_by_bitmap(docs, "doc_id", wanted).join(wanted, "doc_id")
    half = (length - GRAM) // 2

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                b = (text or "").encode("utf-8", "replace")
                for p in places:
                    pos, kind = p["pos"], p["kind"]
                    if kind != 3 and pos >= half:  # windows with at least half of the rest to the left
                        lo = max(0, pos - (length - GRAM))
                        part = (p["anchor"] * 2 + (crc32(b[pos - half : pos]) << 20)) & _LARGEST
                        rows.append((part % ranges, part, doc, lo, pos - lo, b[lo : pos - half + length]))
                    if kind != 2 and pos + length - half < len(b):  # and those with less
                        lo = max(0, pos - half + 1)
                        part = (p["anchor"] * 2 + 1 + (crc32(b[pos + GRAM : pos + GRAM + half]) << 20)) & _LARGEST
                        rows.append((part % ranges, part, doc, lo, pos - lo, b[lo : pos + length]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

    fields = pa.schema([("r", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int64()), ("reach", pa.int64()), ("bytes", pa.binary())])
    contexts = some.select("doc_id", "text", "places").mapInArrow(fetch, "r long, part long, doc_id long, begin long, reach long, bytes binary")
    return contexts.groupBy("r").applyInPandas(lambda frame: repeats(frame, length), "doc_id long, begin long, end long")


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["begin"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = 50, bits: int = CONTEXT_BITS) -> DataFrame:
    """(doc_id, spans array<struct<begin, end>>) in bytes of the documents that lose something; spans may overlap."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    with small_batches(docs.sparkSession):
        found, runs = equal_contexts(slim, length, max(1, size // 3_000_000), bits)
        asked = found.filter("kind >= 2")
        n = asked.count()
        spans = runs.filter("same").select("doc_id", "begin", "end").unionByName(sort_contexts(slim, asked, length, max(partitions(docs), n // 10_000)))
        out = checkpoint(spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    discard(found, runs)
    return out


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256) of every document. Only documents with spans are shuffled."""
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                b = (text or "").encode("utf-8", "replace")
                runs = [(a, min(e, len(b))) for a, e in _merged(found or []) if a < len(b)]
                kept, at = [], 0
                for a, e in runs:
                    kept.append(b[at:a])
                    at = e
                kept = b"".join([*kept, b[at:]])
                rows.append((doc, len(b), len(b) - len(kept), len(runs), kept, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields) if rows else pa.RecordBatch.from_pylist([], fields)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return left_join_marked(slim, "doc_id", spans).select("row.doc_id", "row.text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return cut(docs, repeated_spans(docs)).drop("kept")
