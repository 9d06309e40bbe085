"""Removal of byte strings that already occur in an earlier document.

Every byte covered by a ``width``-byte string (a window) that also starts in a
document with a smaller id is removed. A window is never looked at twice:

1. Documents are put into chunks (a written table of compressed rows).
2. Winnowing: a window's anchor is the smallest hash of the ``gram``-byte
   strings inside it, so equal windows have equal anchors. Consecutive windows
   with one anchor form a run. Each chunk sends its distinct anchors, packed
   by hash range; anchors found in documents of one content only drop out.
3. Each chunk sends the distinct runs of its shared anchors (bytes, smallest
   and largest document id), again by hash range.
4. Per anchor, equal runs are collapsed. Where different runs remain, all
   their windows are sorted as suffixes: ordered by their first eight bytes,
   those equal so far by the next eight, and so on. Neighbours with a common
   extension of ``width`` bytes, compared byte for byte, are equal. The smallest
   id of equal windows is their owner.
5. Owners go back to the chunks, which mark the bytes of windows with a
   smaller owner.

An anchor with very many windows in its distinct runs (a short passage between
ever other neighbours, a word repeated over and over) is split: its chunks send
distinct single windows, the smallest and largest document id of each, and a
window's hash picks one of 2**b sub-groups, b by the anchor's counted windows. Equal windows still meet; each sub-group is sorted alone.

Texts equal to the text of a smaller id are removed whole, found by digest.
Packed rows are pre-aggregated by chunk, so a passage in a third of all
documents is sent once a chunk, not once a document.

Defined cases: a null or empty text has no bytes; texts shorter than a window
are kept; rows that repeat an id do not remove each other; a row without an id
counts as after all others; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import doc_chunks, mix64, prefix_hash, range_hash, salted_join, stage_table

WIDTH, GRAM, CHUNK, SLICE, WINDOWS = 50, 24, 4 << 20, 1 << 19, 1 << 17
MANY, HOT = 256, 1 << 16        # windows of an anchor that a chunk counts from; counted windows that make it hot
NO_ID = np.int64(2**63 - 1)
COPY, SHARED, OWNERS, TEXT = 0, 1, 2, 9         # kinds of the rows a chunk meets, texts last


# ---------------------------------------------------------------------------
# packed arrays
# ---------------------------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; wide numbers are stored by byte plane."""
    import zstandard as zstd
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if a.itemsize > 1 and len(a) else a
        parts += [struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)), planes.tobytes()]
    return zstd.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(value: bytes) -> list[np.ndarray]:
    import zstandard as zstd
    raw = zstd.ZstdDecompressor().decompress(value)
    n, at, out = struct.unpack_from("<I", raw)[0], 4, []
    for _ in range(n):
        kind, length = struct.unpack_from("<2sQ", raw, at)
        dtype = np.dtype("<" + kind.decode())
        at += 10
        size = dtype.itemsize * length
        a = np.frombuffer(raw, np.uint8, size, at)
        if dtype.itemsize > 1 and length:
            a = np.ascontiguousarray(a.reshape(dtype.itemsize, length).T).view(dtype).ravel()
        else:
            a = a.view(dtype)
        out.append(a)
        at += size
    return out


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.zeros(1, x.dtype))


def _undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def _heads(x: np.ndarray) -> np.ndarray:
    """Where each stretch of equal values of a sorted array starts."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .. and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    return np.arange(total) - np.repeat(first, count) + np.repeat(start, count)


# ---------------------------------------------------------------------------
# runs
# ---------------------------------------------------------------------------

def runs_of(data: np.ndarray, off: np.ndarray, width: int, gram: int):
    """(anchor, first window, windows, document, key) of every run of a slice;
    windows lie within one document. The key identifies anchor and bytes."""
    empty = np.zeros(0, np.int64)
    if len(data) < width:
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64)
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    low = range_hash(prefix, at, at + gram)
    span, have = width - gram + 1, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(low)]
    inside = np.flatnonzero(np.arange(len(low)) + width <= off[doc + 1])
    if not len(inside):
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64)
    low, doc = low[inside], doc[inside]
    head = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(head, len(inside)))
    # smallest hashes crowd at the low end; mixed once more they spread evenly over parts
    first, anchor, doc = inside[head], mix64(low[head]), doc[head]
    key = mix64(anchor ^ range_hash(prefix, first, first + count + width - 1))
    return anchor, first, count, doc, key


def slices(off: np.ndarray, width: int, size: int = SLICE):
    """Pieces of a chunk for the run kernel: (first byte, end byte, offsets,
    first document). A long document is cut into pieces that overlap by
    ``width`` - 1 bytes, so each window lies in one piece."""
    i, n = 0, len(off) - 1
    while i < n:
        if off[i + 1] - off[i] > size:
            a = off[i]
            while a < off[i + 1]:
                b = min(off[i + 1], a + size + width - 1)
                yield a, b, np.array([0, b - a]), i
                a += size
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield off[i], off[j], off[i:j + 1] - off[i], i
        i = j


def chunk_runs(data: np.ndarray, off: np.ndarray, width: int, gram: int):
    """``runs_of`` a whole chunk, slice by slice: (anchor, first, count, document, key)."""
    for a, b, o, d in slices(off, width):
        anchor, first, count, doc, key = runs_of(data[a:b], o, width, gram)
        if len(anchor):
            yield anchor, first + a, count, doc + d, key


# ---------------------------------------------------------------------------
# hot anchors
# ---------------------------------------------------------------------------

def _merge_runs(anchor: np.ndarray, key: np.ndarray, doc: np.ndarray):
    """(one run, smallest, largest document) of every distinct run, by anchor and key."""
    order = np.lexsort((key, anchor))
    heads = _heads(key[order])
    if not len(heads):
        return heads, doc[heads], doc[heads]
    return order[heads], np.minimum.reduceat(doc[order], heads), np.maximum.reduceat(doc[order], heads)


def distinct_windows(count: np.ndarray, key: np.ndarray, heads: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the anchor, windows of its distinct runs) for those anchors of
    an array of runs sorted by anchor whose distinct runs have ``many`` windows or more."""
    if not len(heads):
        return heads, heads
    size = np.diff(np.append(heads, len(count)))
    big = np.flatnonzero(np.add.reduceat(count, heads) >= many)
    at, group = _ranges(heads[big], size[big]), np.repeat(np.arange(len(big)), size[big])
    one = _merge_runs(group, key[at], group)[0]
    total = np.bincount(group[one], count[at][one], minlength=len(big)).astype(np.int64)
    return big[total >= many], total[total >= many]


def sub_bits(windows: np.ndarray) -> np.ndarray:
    """Bits of the sub-group of a hot anchor of so many counted windows."""
    return np.ceil(np.log2(np.maximum(2.0, windows / (WINDOWS >> 3)))).astype(np.uint8)


def single_windows(data: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, bits: np.ndarray,
                   width: int):
    """(run, first byte, sub-group, key) of every window of runs of hot anchors."""
    length = count + width - 1
    start = np.cumsum(length) - length
    prefix = prefix_hash(data[_ranges(first, length)])
    at = _ranges(start, count)
    h = range_hash(prefix, at, at + width)
    run = np.repeat(np.arange(len(first)), count)
    sub = h & ((np.uint64(1) << bits[run].astype(np.uint64)) - np.uint64(1))
    group = mix64(anchor[run] ^ mix64(sub + np.uint64(1)))
    return run, _ranges(first, count), group, mix64(group ^ h)


def hot_windows(data, first, count, anchor, low, high, bits, width: int):
    """Distinct windows of a chunk's runs of hot anchors: (run, first byte,
    sub-group, smallest, largest document); so many runs at a time that the
    arrays stay bounded."""
    size, at, parts = np.cumsum(count), 0, []
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(size, size[at] - count[at] + SLICE, "right")))
        s = slice(at, end)
        run, byte, group, key = single_windows(data, first[s], count[s], anchor[s], bits[s], width)
        one, least, _ = _merge_runs(group, key, low[s][run])
        most = _merge_runs(group, key, high[s][run])[2]
        parts.append((run[one] + at, byte[one], group[one], key[one], least, most))
        at = end
    run, byte, group, key, least, most = (np.concatenate(x) for x in zip(*parts, strict=True))
    one, low, _ = _merge_runs(group, key, least)
    return run[one], byte[one], group[one], low, _merge_runs(group, key, most)[2]


def find_hot(anchor: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each anchor is one of ``hot`` (sorted), and its index there."""
    if not len(hot):
        return np.zeros(len(anchor), bool), np.zeros(len(anchor), np.int64)
    at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
    return hot[at] == anchor, at


# ---------------------------------------------------------------------------
# suffix sort
# ---------------------------------------------------------------------------

class Suffixes:
    """Suffixes of a byte array, compared on their first ``width`` bytes (which
    each of them has), eight bytes at a time."""

    def __init__(self, data: np.ndarray, width: int):
        self.width = width
        self.eight = np.zeros(len(data) + 1, np.uint64)      # the next eight bytes as a number
        for i in range(min(8, width)):
            self.eight[:len(data) - i] |= data[i:].astype(np.uint64) << np.uint64(56 - 8 * i)

    def words(self, at: np.ndarray, step: int) -> np.ndarray:
        """Bytes ``step`` to ``step`` + 8 of the suffixes as numbers; those from ``width`` on count as 0."""
        w = self.eight[np.minimum(at + step, len(self.eight) - 1)]
        over = step + 8 - self.width
        return w if over <= 0 else w & ~np.uint64((1 << 8 * over) - 1)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension at a and b."""
        got, live = np.full(len(a), self.width, np.int64), np.arange(len(a))
        for step in range(0, self.width, 8):
            x = self.words(a[live], step) ^ self.words(b[live], step)
            other = x != 0
            y = x[other]
            got[live[other]] = step + sum((y < np.uint64(1 << 64 - 8 * k)).astype(np.int64) for k in range(1, 8))
            live = live[~other]
        return got

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes at ``at`` within each (contiguous) group; equal ones in any order.

        All groups at once, from the first eight bytes on: suffixes of a group
        that are equal so far make a stretch, which is ordered by the next
        eight bytes and parts where those differ. A suffix alone in its
        stretch has its place."""
        order, stretch = np.arange(len(at)), _dense(group)[:len(at)]
        live = np.arange(len(at))                            # places in stretches of several
        for step in range(0, self.width, 8):
            size = np.bincount(stretch)[stretch] if len(live) else stretch
            live, stretch = live[size > 1], stretch[size > 1]
            if not len(live):
                break
            mine = order[live]
            # one number: the stretch, then the rank of the eight bytes
            word = self.words(at[mine], step)
            by = np.argsort(word)
            rank = np.empty(len(by), np.int64)
            rank[by] = _dense(word[by])
            key = _dense(stretch) * len(by) + rank
            by = np.argsort(key)
            order[live] = mine[by]
            stretch = _dense(key[by])
        return order


def _dense(x: np.ndarray) -> np.ndarray:
    """0, 1, ... for the distinct values of a sorted array."""
    return np.cumsum(np.concatenate(([0], x[1:] != x[:-1])))


def window_owners(s: Suffixes, start: np.ndarray, count: np.ndarray, group: np.ndarray, doc: np.ndarray
                  ) -> np.ndarray:
    """Smallest document of each window's equals within its group; runs are
    given by first byte, windows, group (contiguous) and document."""
    at, g, d = _ranges(start, count), np.repeat(group, count), np.repeat(doc, count)
    order = s.sort(at, g)
    a, b = at[order[:-1]], at[order[1:]]
    same = (g[order[:-1]] == g[order[1:]])
    near = np.flatnonzero(same)
    near = near[s.common(a[near], b[near]) >= s.width]
    joined = np.zeros(len(order), bool)
    joined[near + 1] = True
    heads = np.flatnonzero(~joined)
    low = np.minimum.reduceat(d[order], heads) if len(order) else d
    out = np.empty_like(d)
    out[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return out


# ---------------------------------------------------------------------------
# task functions
# ---------------------------------------------------------------------------

def _batch(rows: list[tuple], kinds: dict):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values(), strict=True)],
                                      names=list(kinds))


def split_parts(part: np.ndarray):
    """(part, row indices) of every part of a sorted array."""
    heads = _heads(part)
    for a, b in zip(heads, np.append(heads[1:], len(part)), strict=True):
        yield int(part[a]), slice(a, b)


def _make_chunks(batches):
    import pyarrow as pa
    from pyspark import TaskContext
    kinds = {"chunk": pa.int64(), "kind": pa.int32(), "size": pa.int64(), "body": pa.binary()}
    number = TaskContext.get().partitionId() << 32
    ids, known, lens, parts, size = [], [], [], [], 0

    def flush():
        nonlocal number, ids, known, lens, parts, size
        body = pack(np.concatenate(ids), np.concatenate(known), np.concatenate(lens), np.concatenate(parts))
        row = _batch([(number, TEXT, size, body)], kinds)
        number, ids, known, lens, parts, size = number + 1, [], [], [], [], 0
        return row
    for b in batches:
        has = b.column(0).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        key = b.column(0).fill_null(int(NO_ID)).to_numpy()
        for i, j, data, off in doc_chunks(None, b.column(1)):
            ids.append(key[i:j])
            known.append(has[i:j])
            lens.append(np.diff(off))
            parts.append(data)
            size += len(data)
            if size >= CHUNK or sum(map(len, ids)) >= 1 << 16:
                yield flush()
    if ids:
        yield flush()


def _open(body: bytes):
    ids, known, lens, data = unpack(body)
    return ids, known, np.concatenate(([0], np.cumsum(lens))), data


def _digests(batches):
    import pyarrow as pa
    kinds = {"chunk": pa.int64(), "row": pa.int32(), "doc_id": pa.int64(), "size": pa.int64(), "c1": pa.int64(),
             "c2": pa.int64()}
    for b in batches:
        for chunk, body in zip(b.column(0), b.column(1), strict=True):
            ids, _, off, data = _open(body.as_py())
            raw, rows = data.tobytes(), []
            for i in range(len(ids)):
                c1, c2 = struct.unpack("<qq", hashlib.sha256(raw[off[i]:off[i + 1]]).digest()[:16])
                rows.append((chunk.as_py(), i, int(ids[i]), int(off[i + 1] - off[i]), c1, c2))
            yield _batch(rows, kinds)


def _anchor_rows(width: int, gram: int, bits: int):
    def run(batches):
        import pyarrow as pa
        kinds = {"part": pa.int64(), "chunk": pa.int64(), "body": pa.binary()}
        shift = np.uint64(64 - bits)
        for b in batches:
            for chunk, body in zip(b.column(0), b.column(1), strict=True):
                ids, _, off, data = _open(body.as_py())
                raw = data.tobytes()
                content = np.array([struct.unpack("<Q", hashlib.sha256(raw[off[i]:off[i + 1]]).digest()[:8])[0] | 1
                                    for i in range(len(ids))], np.uint64)
                got = [(a, content[d], n, k) for a, _, n, d, k in chunk_runs(data, off, width, gram)]
                if not got:
                    continue
                anchor, text, count, key = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.argsort(anchor)
                anchor, text = anchor[order], text[order]
                heads = _heads(anchor)
                many, windows = distinct_windows(count[order], key[order], heads, MANY)
                low, high = np.minimum.reduceat(text, heads), np.maximum.reduceat(text, heads)
                anchor, text = anchor[heads], np.where(low == high, low, np.uint64(0))     # 0: several contents
                rows = []
                for part, s in split_parts(anchor >> shift):
                    table, index = np.unique(text[s], return_inverse=True)
                    m = slice(*np.searchsorted(many, (s.start, s.stop)))
                    rows.append((part, chunk.as_py(), pack(_delta(anchor[s]), table, index.astype(np.uint32),
                                                           (many[m] - s.start).astype(np.uint32),
                                                           windows[m].astype(np.uint32))))
                yield _batch(rows, kinds)
    return run


def by_part(batches):
    """(part, [(chunk, body), ...]) of rows sorted by part."""
    now, held = None, []
    for b in batches:
        for part, chunk, body in zip(*(b.column(i) for i in range(3)), strict=True):
            if part.as_py() != now:
                if held:
                    yield held
                now, held = part.as_py(), []
            held.append((chunk.as_py(), body.as_py()))
    if held:
        yield held


def _shared_rows(width: int, gram: int, hot_from: int):
    def run(batches):
        import pyarrow as pa
        kinds = {"chunk": pa.int64(), "kind": pa.int32(), "body": pa.binary()}
        for held in by_part(batches):
            anchors, texts, more = [], [], []
            for _, body in held:
                delta, table, index, many, windows = unpack(body)
                anchors.append(_undelta(delta))
                texts.append(table[index])
                more.append((anchors[-1][many], windows.astype(np.int64)))
            lens = [len(a) for a in anchors]
            anchor, text = np.concatenate(anchors), np.concatenate(texts)
            order = np.argsort(anchor)
            a, t = anchor[order], text[order]
            heads = _heads(a)
            size = np.diff(np.append(heads, len(a)))
            low, high = np.minimum.reduceat(t, heads), np.maximum.reduceat(t, heads)
            hit = np.zeros(len(a), bool)
            hit[order] = np.repeat((low != high) | (low == 0), size)
            # windows of an anchor: what the chunks counted, and a whole run for each chunk
            counted, windows = (np.concatenate(x) for x in zip(*more, strict=True))
            weight = np.bincount(np.searchsorted(a[heads], counted), windows, minlength=len(heads)).astype(np.int64)
            weight += size * (width - gram + 1)
            big = weight > hot_from
            hot, bits = a[heads][big], sub_bits(weight[big])
            rows, at = [], 0
            for (chunk, _), mine, n in zip(held, anchors, lens, strict=True):
                if hit[at:at + n].any():
                    mine = mine[hit[at:at + n]]
                    is_hot, i = find_hot(mine, hot)
                    rows.append((chunk, SHARED, pack(_delta(mine), mine[is_hot], bits[i[is_hot]])))
                at += n
            if rows:
                yield _batch(rows, kinds)
    return run


def _by_chunk(batches):
    """(chunk, copies, bodies of the wanted kind, text body) of rows sorted by chunk and kind."""
    now, copies, bodies = None, [], []
    for b in batches:
        for chunk, kind, body in zip(*(b.column(i) for i in range(3)), strict=True):
            if chunk.as_py() != now:
                now, copies, bodies = chunk.as_py(), [], []
            if kind.as_py() == COPY:
                copies.append(np.frombuffer(body.as_py(), ">i4").astype(np.int64))
            elif kind.as_py() == TEXT:
                yield now, copies, bodies, body.as_py()
                bodies = []
            else:
                bodies.append(body.as_py())


def _sorted_hot(lists: list, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hot anchors, sorted, and their bits, of unpacked rows that have them from place ``at``."""
    hot, where = np.unique(np.concatenate([x[at] for x in lists]), return_index=True)
    return hot, np.concatenate([x[at + 1] for x in lists])[where]


def _run_rows(width: int, gram: int, bits: int):
    def run(batches):
        import pyarrow as pa
        kinds = {"part": pa.int64(), "chunk": pa.int64(), "body": pa.binary()}
        shift = np.uint64(64 - bits)
        for chunk, copies, bodies, text in _by_chunk(batches):
            if not bodies:
                continue
            lists = [unpack(x) for x in bodies]
            shared = np.sort(np.concatenate([_undelta(x[0]) for x in lists]))
            hot, bits_of = _sorted_hot(lists, 1)
            ids, _, off, data = _open(text)
            skip = np.zeros(len(ids), bool)
            for c in copies:
                skip[c] = True
            got = []
            for anchor, first, count, doc, key in chunk_runs(data, off, width, gram):
                at = np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)
                ok = np.flatnonzero((shared[at] == anchor) & ~skip[doc])
                got.append((anchor[ok], first[ok], count[ok], ids[doc[ok]], key[ok]))
            anchor, first, count, doc, key = (np.concatenate(x) for x in zip(*got, strict=True))
            if not len(anchor):
                continue
            one, low, high = _merge_runs(anchor, key, doc)
            anchor, first, count = anchor[one], first[one], count[one]
            source = None
            if len(hot):
                is_hot, i = find_hot(anchor, hot)
                h = np.flatnonzero(is_hot)
                cold, i = ~is_hot, i[h]
                if len(h):
                    run, byte, group, least, most = hot_windows(data, first[h], count[h], anchor[h], low[h], high[h],
                                                                bits_of[i], width)
                    source = np.concatenate((np.full(cold.sum(), -1), i[run]))
                    anchor, first = np.concatenate((anchor[cold], group)), np.concatenate((first[cold], byte))
                    count = np.concatenate((count[cold], np.ones_like(run)))
                    low, high = np.concatenate((low[cold], least)), np.concatenate((high[cold], most))
                    order = np.argsort(anchor, kind="stable")
                    anchor, first, count, low, high, source = (
                        x[order] for x in (anchor, first, count, low, high, source))
            rows, held = [], 0
            for part, s in split_parts(anchor >> shift):
                n = count[s]
                text_bytes = data[_ranges(first[s], n + width - 1)]
                j = np.zeros(0, np.int64) if source is None else np.unique(source[s])
                j = j[j >= 0]
                rows.append((part, chunk, pack(_delta(anchor[s]), n.astype(np.uint32), low[s], high[s], text_bytes,
                                               hot[j], bits_of[j])))
                held += len(rows[-1][2])
                if held > 8 << 20:
                    yield _batch(rows, kinds)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, kinds)
    return run


def part_owners(anchor, count, low, data, width: int):
    """Owners of the windows of a part's runs: (run, first window, end window,
    owner) segments, and the key of each run."""
    length = count + width - 1
    start = np.cumsum(length) - length
    prefix = prefix_hash(data)
    key = mix64(anchor ^ range_hash(prefix, start, start + length))
    order = np.lexsort((key, anchor))
    k, a = key[order], anchor[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (a[1:] != a[:-1])))
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    # equal keys are checked byte by byte; a run that only collides stands for itself
    mine = np.flatnonzero(~new)
    x, y = order[mine], lead[mine]
    fit = length[x] == length[y]
    px, py = _ranges(start[x[fit]], length[x[fit]]), _ranges(start[y[fit]], length[x[fit]])
    if len(px):
        ends = np.cumsum(length[x[fit]])
        bad = np.add.reduceat((data[px] != data[py]).astype(np.int64), np.concatenate(([0], ends[:-1]))) > 0
        ok = np.zeros(len(mine), bool)
        ok[np.flatnonzero(fit)[~bad]] = True
    else:
        ok = np.zeros(len(mine), bool)
    lead[mine[~ok]] = order[mine[~ok]]
    rep = np.empty(len(order), np.int64)
    rep[order] = lead
    doc = np.full(len(anchor), NO_ID)
    np.minimum.at(doc, rep, low)
    real = order[lead == order]                      # representatives by anchor
    group = np.cumsum(np.concatenate(([0], (anchor[real][1:] != anchor[real][:-1]).astype(np.int64))))
    many = np.bincount(group)[group] > 1
    run_at, owner_at, t0, t1 = [real[~many]], [doc[real[~many]]], [np.zeros((~many).sum(), np.int64)], \
        [count[real[~many]]]
    mixed, g = real[many], group[many]
    cut = _heads(g)
    size = np.cumsum(count[mixed])
    at, suffixes = 0, Suffixes(data, width)
    while at < len(mixed):                           # whole groups, about WINDOWS windows at a time
        base = size[at] - count[mixed[at]]
        stop = int(np.searchsorted(size, base + WINDOWS, "right"))
        later = cut[cut > at]
        end = int(later[later <= stop][-1]) if (later <= stop).any() else int(later[0]) if len(later) else len(mixed)
        end = len(mixed) if stop >= len(mixed) else end
        rows = mixed[at:end]
        own = window_owners(suffixes, start[rows], count[rows], g[at:end], doc[rows])
        r = np.repeat(rows, count[rows])
        t = _ranges(np.zeros(len(rows), np.int64), count[rows])
        head = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (own[1:] != own[:-1]))))
        last = np.append(head[1:], len(r)) - 1
        run_at.append(r[head])
        owner_at.append(own[head])
        t0.append(t[head])
        t1.append(t[last] + 1)
        at = end
    return (np.concatenate(run_at), np.concatenate(t0), np.concatenate(t1), np.concatenate(owner_at)), rep, key


def _owner_rows(width: int):
    def run(batches):
        import pyarrow as pa
        kinds = {"chunk": pa.int64(), "kind": pa.int32(), "body": pa.binary()}
        for held in by_part(batches):
            cols = [unpack(body) for _, body in held]
            lens = [len(c[0]) for c in cols]
            anchor = np.concatenate([_undelta(c[0]) for c in cols])
            count = np.concatenate([c[1] for c in cols]).astype(np.int64)
            low, high, data = (np.concatenate([c[i] for c in cols]) for i in (2, 3, 4))
            hots = [(c[5], c[6]) for c in cols]
            (r, t0, t1, owner), rep, key = part_owners(anchor, count, low, data, width)
            order = np.argsort(r, kind="stable")
            r, t0, t1, owner = r[order], t0[order], t1[order], owner[order]
            first, last = np.searchsorted(r, rep, "left"), np.searchsorted(r, rep, "right")
            entry = np.repeat(np.arange(len(rep)), last - first)
            seg = _ranges(first, last - first)
            use = owner[seg] < high[entry]
            entry, seg = entry[use], seg[use]
            ends = np.cumsum(lens)
            cut = np.searchsorted(entry, np.concatenate(([0], ends)))
            rows = []
            for (chunk, _), a, b, hot in zip(held, cut[:-1], cut[1:], hots, strict=True):
                if b > a:
                    e, s = entry[a:b], seg[a:b]
                    rows.append((chunk, OWNERS, pack(key[e], t0[s].astype(np.uint32), t1[s].astype(np.uint32),
                                                     owner[s], *hot)))
            if rows:
                yield _batch(rows, kinds)
    return run


def _mark(data, off, ids, copies, bodies, width: int, gram: int) -> np.ndarray:
    """Mask of the removed bytes of a chunk."""
    edge = np.zeros(len(data) + 1, np.int32)
    for c in copies:
        np.add.at(edge, off[c], 1)
        np.add.at(edge, off[c + 1], -1)
    if bodies:
        lists = [unpack(x) for x in bodies]
        key, t0, t1, owner = (np.concatenate(x) for x in list(zip(*lists, strict=True))[:4])
        hot, bits = _sorted_hot(lists, 4)
        order = np.argsort(key, kind="stable")
        key, t0, t1, owner = key[order], t0[order].astype(np.int64), t1[order].astype(np.int64), owner[order]
        for anchor, first, count, doc, mine in chunk_runs(data, off, width, gram):
            if len(hot):
                is_hot, i = find_hot(anchor, hot)
                h = np.flatnonzero(is_hot)
                r, at, _, window = single_windows(data, first[h], count[h], anchor[h], bits[i[h]], width)
                first, doc = np.concatenate((first[~is_hot], at)), np.concatenate((doc[~is_hot], doc[h][r]))
                mine = np.concatenate((mine[~is_hot], window))
            a, b = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
            i = np.repeat(np.arange(len(mine)), b - a)
            s = _ranges(a, b - a)
            use = owner[s] < ids[doc[i]]
            i, s = i[use], s[use]
            np.add.at(edge, first[i] + t0[s], 1)
            np.add.at(edge, first[i] + t1[s] + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _result_rows(width: int, gram: int):
    def run(batches):
        import pyarrow as pa
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "spans": span, "kept": pa.binary()}
        for _, copies, bodies, text in _by_chunk(batches):
            ids, known, off, data = _open(text)
            gone = _mark(data, off, ids, copies, bodies, width, gram)
            rows, size = [], 0
            for i in range(len(ids)):
                m = gone[off[i]:off[i + 1]]
                if m.any():
                    flip = np.flatnonzero(np.diff(np.concatenate(([0], m.view(np.int8), [0]))))
                    spans = [{"start": int(s), "end": int(e)} for s, e in flip.reshape(-1, 2)]
                    kept = data[off[i]:off[i + 1]][~m].tobytes()
                else:
                    spans, kept = [], data[off[i]:off[i + 1]].tobytes()
                rows.append((int(ids[i]) if known[i] else None, int(off[i + 1] - off[i]), spans, kept))
                size += len(kept)
                if size > 4 << 20 or len(rows) >= 4096:
                    yield _batch(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, kinds)
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   gram: int = GRAM, hot_from: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the removed byte spans
    (start, end exclusive, maximal) and the remaining bytes. ``hot_from``: counted
    windows above which an anchor is split; it changes where windows meet, not the result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chunks = stage_table(rows.mapInArrow(_make_chunks, "chunk long, kind int, size long, body binary"), "chunks")
    n_chunks, total = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    bodies = chunks.select("chunk", "body")
    # texts that an earlier id already has
    digest = stage_table(bodies.mapInArrow(_digests, "chunk long, row int, doc_id long, size long, c1 long, c2 long")
                         .where(F.col("size") >= width), "digests")
    first = digest.groupBy("c1", "c2", "size").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .where("_n > 1").drop("_n")
    copies = salted_join(digest, first, ["c1", "c2", "size"], F.struct("chunk", "row")).where("doc_id > _first")
    # rows as big-endian numbers, collected within their chunk (which has a bounded number of them)
    copies = stage_table(copies.groupBy("chunk").agg(F.collect_list("row").alias("_rows")).select(
        "chunk", F.lit(COPY).alias("kind"),
        F.unhex(F.array_join(F.transform("_rows", lambda r: F.lpad(F.hex(r), 8, "0")), "")).alias("body")), "copies")

    def parts(per: int) -> int:                      # as a number of bits of the anchor
        return max(6, int(np.ceil(np.log2(max(1, total / per)))))

    def met(*frames: DataFrame) -> DataFrame:        # rows of a chunk together, its text last
        out = chunks.select("chunk", "kind", "body")
        for f in frames:
            out = out.unionByName(f.select("chunk", "kind", "body"))
        return out.repartition(max(1, n_chunks), "chunk").sortWithinPartitions("chunk", "kind")

    def dealt(df: DataFrame, bits: int) -> DataFrame:
        return df.repartition(1 << bits, "part").sortWithinPartitions("part")
    part_row, chunk_row = "part long, chunk long, body binary", "chunk long, kind int, body binary"
    bits = parts(16 << 20)
    shared = dealt(bodies.mapInArrow(_anchor_rows(width, gram, bits), part_row), bits)
    shared = stage_table(shared.mapInArrow(_shared_rows(width, gram, hot_from), chunk_row), "shared")
    bits = parts(4 << 20)
    runs = dealt(met(copies, shared).mapInArrow(_run_rows(width, gram, bits), part_row), bits)
    owners = stage_table(runs.mapInArrow(_owner_rows(width), chunk_row), "owners")
    return met(copies, owners).mapInArrow(
        _result_rows(width, gram),
        "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
