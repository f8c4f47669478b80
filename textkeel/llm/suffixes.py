"""Removal of repeated 100-byte strings by suffix arrays.

Every byte covered by a 100-byte string that also starts earlier (smaller doc_id,
or the same document, earlier) goes. Exact, in these steps:

1. Anchors. Of the 64 37-byte substrings of a 100-byte window the first one with the
   least hash is its anchor; equal windows have equal anchors at equal places. Anchors
   are counted over the corpus, and only windows whose anchor occurs more than once go on.
2. Shards. The regions such windows cover (equal regions once) are sorted by a
   suffix array, refined by prefix doubling in the manner of Larsson and Sadakane
   (only unsorted groups are sorted again), in numpy; Kasai's common prefixes
   (in the permuted form: computed where irreducible, carried on elsewhere) tell
   which windows are equal; all but the first are repeats.
3. Merge. First windows travel as short segments, one an anchor, to the range of their
   anchor. There the suffixes that begin at anchors, of all shards, are kept in sorted
   order with the common prefixes of neighbours, and so is what stands before the
   anchors, read backwards; each segment is found in both by binary search. A window is
   a piece before and a piece from the anchor on; it is the same as another where
   common prefixes are at least as long as both pieces. Of windows that are the same,
   those of other shards' than the earliest are repeats (one shard's are told apart in step 2).
4. The spans return to their shard, where documents are cut.

A shard's regions are worked through in chunks of bounded bytes, so memory does
not follow the amount of repetition. Hashes only choose anchors and ranges; whether
strings are equal is decided by their bytes.

Defined results: a null text is empty; null ids come after all others; repeated
rows (equal id and text) are cut like any copies, the first of them kept;
matches never cross documents; an empty table gives an empty result. Extra
columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bytetext import Prefix, U, mix, pieces
from .scratch import Scratch, prepare_python, trim
from .shards import Shards, told_counts, unpack_rows

WIDTH, GRAM = 100, 37
SPAN = WIDTH - GRAM + 1  # 64 grams in a window
CHUNK = 1 << 20


# ---------------------------------------------------------------- suffix arrays


def suffix_array(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Suffix array of several strings laid end to end (``cuts``: offsets). A
    suffix ends where its string does; ended ones come first, by string."""
    n, strings = data.size, len(cuts)
    cuts = cuts.astype(np.int32)
    end = np.repeat(cuts[1:], np.diff(cuts))
    owner = np.repeat(np.arange(strings - 1, dtype=np.int32), np.diff(cuts))
    left = np.minimum(end - np.arange(n, dtype=np.int32), 7)
    key = left.astype(U)
    for k in range(min(7, n)):
        key[: n - k] |= np.where(left[: n - k] > k, data[k:], np.uint8(0)).astype(U) << U(56 - 8 * k)
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key, left
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    h = 7
    while True:
        again = ~new
        again[:-1] |= ~new[1:]
        at = np.flatnonzero(again).astype(np.int32)  # places of unsorted groups
        if not at.size:
            return sa
        p = sa[at]
        q = p + np.int32(h)
        # one key of a suffix's group and of what follows it; the order of equal keys is settled later
        both = rank[p].astype(np.int64) * (n + strings)
        both += np.where(q < end[p], rank[np.minimum(q, n - 1)] + np.int32(strings), owner[p])
        order = np.argsort(both)
        p, both = p[order], both[order]
        sa[at] = p
        fresh = np.ones(at.size, bool)
        np.not_equal(both[1:], both[:-1], out=fresh[1:])
        new[at] = fresh
        rank[p] = np.maximum.accumulate(np.where(fresh, at, np.int32(0)))
        h *= 2


def common_prefixes(data: np.ndarray, cuts: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Kasai's array, per place in ``sa``: the prefix it shares with the place before."""
    n = data.size
    end = np.repeat(cuts[1:].astype(np.int32), np.diff(cuts))
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    starts = np.zeros(n + 1, bool)
    starts[cuts] = True
    i = np.arange(n, dtype=np.int32)
    carried = (before > 0) & ~starts[:n]
    carried[carried] &= ~starts[before[carried]]
    carried[carried] &= data[i[carried] - 1] == data[before[carried] - 1]
    todo = np.flatnonzero(~carried & (before >= 0)).astype(np.int32)
    shared = np.zeros(n, np.int32)
    a, b = todo.copy(), before[todo]
    room = np.minimum(end[a] - a, end[b] - b)
    step = 0
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(wide, (n + 1, 8), (1, 1))
    while todo.size:
        x, y = eight[a + step], eight[b + step]
        same = (x == y).argmin(axis=1)
        same[(x == y).all(axis=1)] = 8
        shared[todo] = np.minimum(step + same, room)
        on = (same == 8) & (step + 8 < room)
        todo, a, b, room = todo[on], a[on], b[on], room[on]
        step += 8
    source = np.maximum.accumulate(np.where(carried, np.int32(0), i))
    return (shared[source] - (i - source))[sa] * (before[sa] >= 0)


# --------------------------------------------------------------------- anchors


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every ``width`` (a power of two) consecutive values."""
    k = 1
    while k < width:
        x = pick(x[:-k], x[k:])
        k *= 2
    return x


def _window_anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash of each window start, which starts are valid, gram hashes."""
    n = data.size
    if n < WIDTH:
        return np.zeros(0, U), np.zeros(0, bool), np.zeros(0, U)
    grams = Prefix(data).windows(GRAM)
    grams = np.concatenate([grams, Prefix(data[n - GRAM :]).spans(np.array([0]), np.array([GRAM]))])
    least = _slide(grams, SPAN, np.minimum)
    end = np.repeat(offs[1:], np.diff(offs))[: least.size]
    return least, np.arange(least.size) + WIDTH <= end, grams


def _spread(anchors: np.ndarray) -> np.ndarray:
    """Anchors are least hashes, so all are small; these fill the whole range evenly."""
    return mix(anchors ^ U(0x5851F42D4C957F2D))


def _places(grams: np.ndarray, least: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Where the anchor of each window of the runs [a, z] of one least hash begins: at the
    first gram of the window that has it."""
    place = np.zeros(least.size, np.int32)
    while a.size:
        p, value = a.copy(), least[a]
        open_ = np.flatnonzero(grams[p] != value)
        while open_.size:
            p[open_] += 1
            open_ = open_[grams[p[open_]] != value[open_]]
        many = np.minimum(z, p) - a + 1
        place[np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())] = np.repeat(p, many)
        on = p < z  # the run goes on past that gram: its hash stands again
        a, z = p[on] + 1, z[on]
    return place


def _keys(rows: pa.Table, shift: U) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for _, _, data, offs in pieces(rows.column("text")):
        least, valid, grams = _window_anchors(data, offs)
        if not least.size:
            continue
        padded = np.concatenate([np.zeros(SPAN - 1, U), np.where(valid, least, U(0)), np.zeros(SPAN - 1, U)])
        most = _slide(padded, SPAN, np.maximum)[: grams.size]  # of the windows that hold the gram
        found.append(_spread(grams[most == grams]) >> shift)
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U), np.zeros(0, int))


# ---------------------------------------------------------------------- shards


def _in_order(rows: pa.Table) -> pa.Table:
    """Rows of a shard by id (null last) and text: the same order in every pass."""
    return rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])


class _Spans:
    """Repeated spans of a shard: row, start, end."""

    def __init__(self):
        self.parts: list[np.ndarray] = []

    def add(self, row: np.ndarray, start: np.ndarray, hit: np.ndarray, joined: np.ndarray) -> None:
        """Runs of hit windows; ``joined``: the window follows the one before."""
        at = np.flatnonzero(hit)
        if at.size:
            new = np.concatenate([[True], (np.diff(at) != 1) | ~joined[at[1:]]])
            first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, at.size - 1)]
            self.parts.append(np.stack([row[first], start[first], start[last] + WIDTH], 1).astype(np.int64))

    def blob(self) -> bytes:
        return np.concatenate(self.parts).astype("<i8").tobytes() if self.parts else b""


_OUT = "part int, shard long, head binary, body binary"


def _repeats_in_chunk(data, cuts, row, begin, spans: _Spans):
    """Of regions (data[cuts[k]:cuts[k+1]], of ``row`` at ``begin``, in order): record
    repeats; return which window starts are first ones."""
    h = Prefix(data).spans(cuts[:-1], cuts[1:])
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    size = np.diff(cuts)
    whole = np.zeros(size.size, bool)
    whole[first] = True  # np.unique names the first of equal regions
    owner = np.repeat(np.arange(size.size), size)
    inside = np.arange(data.size) - cuts[:-1][owner]
    twin = first[inverse.ravel()]
    if data.size:  # equal hashes of unequal regions: each is sorted for itself
        other = np.minimum(cuts[:-1][twin][owner] + inside, data.size - 1)
        whole |= (size != size[twin]) | np.logical_or.reduceat(data != data[other], cuts[:-1])
    window = inside + WIDTH <= size[owner]
    repeat = window & ~whole[owner]
    keep = whole[owner]
    sub = np.flatnonzero(keep)
    own_cuts = np.concatenate([[0], np.cumsum(size[whole])])
    sa = suffix_array(data[sub], own_cuts)
    lcp = common_prefixes(data[sub], own_cuts, sa)
    group = np.cumsum(lcp < WIDTH) - 1
    earliest = np.minimum.reduceat(sa, np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))) if sa.size else sa
    later = np.zeros(sub.size, bool)
    if sa.size:
        later[sa] = sa > earliest[group]
    repeat[sub] |= later & window[sub]
    joined = np.concatenate([[False], owner[1:] == owner[:-1]]) if data.size else np.zeros(0, bool)
    spans.add(row[owner], begin[owner] + inside, repeat, joined)
    return window & ~repeat, owner, inside


def _work(parts: int, shift: U):
    def work(rows: pa.Table, reply: pa.Table, shard: int) -> pa.Table:
        out = {"part": [], "shard": [], "head": [], "body": []}
        (keys, _), counts = _keys(rows, shift), told_counts(reply)
        if rows.num_rows:
            rows = _in_order(rows)
            ids = np.asarray(rows.column("doc_id").fill_null(np.iinfo(np.int64).max), np.int64)
            spans = _Spans()
            held: list[tuple] = []  # (bytes, row, begin, anchors of window starts, their places)
            done = 0  # chunks

            def flush():
                nonlocal done
                if not held:
                    return
                done += 1
                data = np.concatenate([x[0] for x in held])
                cuts = np.concatenate([[0], np.cumsum([x[0].size for x in held])])
                row, begin = np.array([x[1] for x in held]), np.array([x[2] for x in held])
                first, owner, inside = _repeats_in_chunk(data, cuts, row, begin, spans)
                anchor = np.concatenate([np.append(x[3], np.zeros(WIDTH - 1, U)) for x in held])
                place = np.concatenate([np.append(x[4] + c, np.zeros(WIDTH - 1, np.int64)) for x, c in zip(held, cuts, strict=False)])
                at = np.flatnonzero(first)
                held.clear()
                if not at.size:
                    return
                new = np.concatenate([[True], (np.diff(at) != 1) | (place[at[1:]] != place[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])])
                a, z = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, at.size - 1)]
                part = (_spread(anchor[a]) >> U(32)).astype(np.int64) * parts >> 32
                order = np.argsort(part, kind="stable")
                a, z, part = a[order], z[order], part[order]
                length = z - a + WIDTH
                packed = length | (place[a] - a) << 16 | done << 32  # length, place of the anchor, chunk
                head = np.stack([ids[row[owner[a]]], np.full(a.size, shard), row[owner[a]], begin[owner[a]] + inside[a], packed], 1).astype("<i8")
                edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                for i, j in zip(edge[:-1], edge[1:], strict=True):
                    size = length[i:j]
                    where = np.repeat(a[i:j] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    out["part"].append(int(part[i]))
                    out["shard"].append(shard)
                    out["head"].append(head[i:j].tobytes())
                    out["body"].append(data[where].tobytes())

            size = 0
            for at, _, data, offs in pieces(rows.column("text")):
                least, valid, grams = _window_anchors(data, offs)
                if not least.size:
                    continue
                change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])]))
                key = _spread(least[change]) >> shift
                place = _search(keys, key)
                place[place == keys.size] = 0
                many = valid[change] & (keys[place] == key) & (counts[place] > 1) if keys.size else np.zeros(change.size, bool)
                ends = np.append(change, least.size)
                wanted = np.repeat(many, np.diff(ends))
                anchors = _places(grams, least, change[many], ends[1:][many] - 1)
                doc = np.searchsorted(offs, np.arange(least.size), "right") - 1 if wanted.any() else np.zeros(0, int)
                hit = np.flatnonzero(wanted)
                if not hit.size:
                    continue
                new = np.concatenate([[True], (np.diff(hit) != 1) | (doc[hit[1:]] != doc[hit[:-1]])])
                for a, z in zip(hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, hit.size - 1)], strict=True):
                    held.append((data[a : z + WIDTH], at + doc[a], a - offs[doc[a]], least[a : z + 1], anchors[a : z + 1].astype(np.int64) - a))
                    size += z - a + WIDTH
                    if size >= CHUNK:
                        flush()
                        size = 0
            flush()
            out["part"].append(-1)
            out["shard"].append(shard)
            out["head"].append(spans.blob())
            out["body"].append(b"")
        return pa.table({"part": pa.array(out["part"], pa.int32()), "shard": pa.array(out["shard"], pa.int64()), "head": pa.array(out["head"], pa.binary()), "body": pa.array(out["body"], pa.binary())})

    return work


# ----------------------------------------------------------------------- merge


def _search(every: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Binary search of ``own`` in ``every``; in ascending order, which keeps to the cache."""
    order = np.argsort(own)
    at = np.empty(own.size, np.int64)
    at[order] = np.searchsorted(every, own[order])
    return at


_AFTER, _BEFORE = 104, 64  # bytes from the anchor on, and before it (100 and 63 matter)


def _fixed(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, step: int) -> np.ndarray:
    """``width`` bytes from ``begin`` on (or backwards), up to ``end``, then zeros."""
    out = np.zeros((begin.size, width), np.uint8)
    for i in range(0, begin.size, 1 << 14):
        at = begin[i : i + (1 << 14), None] + step * np.arange(width)
        inside = at < end[i : i + (1 << 14), None] if step > 0 else at >= end[i : i + (1 << 14), None]
        out[i : i + (1 << 14)] = np.where(inside, data[np.clip(at, 0, data.size - 1)], 0)
    return out


class _Sorted:
    """Suffixes in sorted order, what neighbours share, and where each of ours stands."""

    def __init__(self, fixed: np.ndarray):
        width = fixed.shape[1]
        own = np.ascontiguousarray(fixed).view(f"S{width}").ravel()
        every = np.unique(own)
        self.at = np.searchsorted(every, own)
        table = every.view(np.uint8).reshape(-1, width)
        self.shared = np.concatenate([[0], (table[1:] != table[:-1]).argmax(axis=1)])

    def alike(self, m: int) -> np.ndarray:
        """A number for each of ours, equal where the first ``m`` bytes are."""
        return np.cumsum(self.shared < m)[self.at]


def _merge(rows: pa.Table) -> pa.Table:
    """Among first windows of all shards, the later ones are repeats."""
    trim()
    head = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 5) for x in rows.column("head").to_pylist()])
    data = np.frombuffer(b"".join(rows.column("body").to_pylist()), np.uint8)
    length, place = head[:, 4] & 0xFFFF, head[:, 4] >> 16 & 0xFFFF
    at = np.cumsum(length) - length
    # rank of each segment's document among those here; the chunk of a shard it comes from
    _, rank = np.unique(head[:, :3], axis=0, return_inverse=True)
    rank = rank.ravel().astype(np.int64)
    _, source = np.unique(np.stack([head[:, 1], head[:, 4] >> 32], 1), axis=0, return_inverse=True)
    source = source.ravel()
    after = _Sorted(_fixed(data, at + place, at + length, _AFTER, 1))
    before = _Sorted(_fixed(data, at + place - 1, at, _BEFORE, -1))
    later: list[np.ndarray] = []  # (segment, window) numbers
    for k in range(SPAN):  # windows that begin k bytes before their anchor
        own = np.flatnonzero((place >= k) & (length - place >= WIDTH - k))
        if own.size < 2:
            continue
        key = before.alike(k)[own] * (head.shape[0] + 1) + after.alike(WIDTH - k)[own]
        order = rank[own] << 32 | (head[own, 3] + place[own] - k)
        by = np.lexsort((order, key))
        key, own = key[by], own[by]
        new = np.append(True, key[1:] != key[:-1])
        earliest = np.repeat(own[new], np.diff(np.append(np.flatnonzero(new), own.size)))
        hit = own[source[own] != source[earliest]]
        later.append(np.stack([hit, place[hit] - k], 1))
    hits = np.concatenate(later) if later else np.zeros((0, 2), np.int64)
    hits = hits[np.lexsort((hits[:, 1], hits[:, 0]))]
    seg, inside = hits[:, 0], hits[:, 1]
    shards, blobs = [], []
    if seg.size:
        new = np.append(True, (seg[1:] != seg[:-1]) | (inside[1:] != inside[:-1] + 1))
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, seg.size - 1)
        start = head[seg[first], 3]
        found = np.stack([head[seg[first], 2], start + inside[first], start + inside[last] + WIDTH], 1).astype("<i8")
        shard = head[seg[first], 1]
        for x in np.unique(shard).tolist():
            shards.append(x)
            blobs.append(found[shard == x].tobytes())
    return pa.table({"shard": pa.array(shards, pa.int64()), "head": pa.array(blobs, pa.binary())})


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def cut(ours: pa.Table, spans: pa.Table) -> pa.Table:
        rows = _in_order(unpack_rows(ours))
        got = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(x, "<i8").reshape(-1, 3) for x in spans.column("head").to_pylist())])
        got = got[np.argsort(got[:, 0], kind="stable")]
        removed, runs, digest, sizes, kept = [], [], [], [], []
        for at, to, data, offs in pieces(rows.column("text")):
            own = got[np.searchsorted(got[:, 0], at) : np.searchsorted(got[:, 0], to)]
            base = offs[own[:, 0] - at] if own.size else np.zeros(0, int)
            depth = np.zeros(data.size + 1, np.int64)
            np.add.at(depth, base + own[:, 1], 1)
            np.add.at(depth, base + own[:, 2], -1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.zeros(data.size + 1, bool)
            edge[offs] = True
            starts = gone & np.concatenate([[True], ~gone[:-1]] if data.size else [[]]).astype(bool) | gone & edge[: data.size]
            sums = lambda flags, offs=offs: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
            removed += sums(gone).tolist()
            runs += sums(starts).tolist()
            sizes += np.diff(offs).tolist()
            stays = ~gone
            for i in range(to - at):
                left = data[offs[i] : offs[i + 1]][stays[offs[i] : offs[i + 1]]].tobytes()
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
        return pa.table(
            {"doc_id": rows.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept, pa.binary())}
        )

    return cut


def cut_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of ``docs`` (doc_id,
    text); ``kept``, the remaining bytes, only ``with_text``."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    shards = Shards(docs.select("doc_id", "text"), scratch)
    shift = U(64 - shards.key_bits)
    reply = shards.count_keys(lambda rows: _keys(rows, shift))
    found = shards.answer(reply, _work(2 * shards.count + 1, shift), _OUT, "segments")
    scratch.drop("reply0")
    merged = found.filter("part >= 0").groupBy("part").applyInArrow(_merge, "shard long, head binary")
    spans = scratch.save("spans", found.filter("part < 0").select("shard", "head").union(merged))
    scratch.drop("segments0")
    prepare_python(shards.spark)
    out = scratch.save("result", shards.read().groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(_cut(with_text), _RESULT))
    shards.drop()
    return out


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.drop("kept")
