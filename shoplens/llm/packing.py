"""Packing documents into fixed-length token sequences along a Hilbert curve.

A document's words are hashed into a count vector; a fixed random projection
takes its direction to a few dimensions, each is cut to a grid, and the
position of the grid cell on a Hilbert curve is the document's key. Documents
are range-partitioned and sorted by (key, id), so neighbours on the curve, of
similar content, share sequences. Each partition tokenises its documents in
that order, appends the separator id, and cuts the stream every ``length`` ids.
What is left at a partition's end goes to sequences whose lengths are powers of
two, which need no padding.

Equal keys (copies of one document) are split between partitions by their id,
so no key has to fit into one task.

Defined cases: null or empty text is the separator alone; repeated rows are
packed once each; an empty table gives an empty result; an extra column never
reaches the packer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import doc_chunks, mix64, word_hashes

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
DIMS, BITS, BUCKETS = 4, 12, 256


# ---------------------------------------------------------------------------
# Hilbert key
# ---------------------------------------------------------------------------

def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of grid cells (rows; one column a dimension).

    Works on the transposed bit planes of the index: from the top bit down,
    reflect or exchange the low bits of the axes, then undo the Gray code."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = np.int64(1) << level, (np.int64(1) << level) - 1
        for d in range(dims):
            flip = (x[d] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t ^= np.where(x[-1] & (np.int64(1) << level), (np.int64(1) << level) - 1, 0)
    x ^= t
    key = np.zeros_like(t)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def projection(buckets: int, dims: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims))


def chunk_keys(data: np.ndarray, off: np.ndarray, proj: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert key of each document of a chunk; documents without words get the centre's."""
    nd, buckets = len(off) - 1, len(proj)
    h, _, _, doc = word_hashes(data, off)
    h = mix64(h)
    slot = doc * buckets + (h % np.uint64(buckets)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    vec = np.bincount(slot, weights=sign, minlength=nd * buckets).reshape(nd, buckets)
    norm = np.sqrt((vec * vec).sum(1, keepdims=True))
    low = (vec / np.maximum(norm, 1e-12)) @ proj
    grid = 1 << bits
    cells = np.clip(((np.tanh(low) + 1) / 2 * grid).astype(np.int64), 0, grid - 1)
    return hilbert_key(cells, bits)


def curve_key(text: Column | str, dims: int = DIMS, bits: int = BITS, buckets: int = BUCKETS) -> Column:
    """Column of Hilbert keys (``dims`` * ``bits`` at most 62)."""
    proj = projection(buckets, dims)

    @F.arrow_udf("long")
    def keys(texts):
        import pyarrow as pa
        parts = [chunk_keys(data, off, proj, bits) for _, _, data, off in doc_chunks(None, texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return keys(text)


# ---------------------------------------------------------------------------
# Tokens
# ---------------------------------------------------------------------------

def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write each byte as a printable character: printable
    Latin-1 bytes stand for themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids that ``tokenizers`` gives for a byte-level BPE file.

    The library itself costs about five times the CPU time of the same merges
    in tiktoken, so where the file is a plain byte-level BPE whose ids rank its
    merges, its vocabulary is handed to tiktoken; texts that hold one of its
    added tokens, and files of any other kind, are encoded by ``tokenizers``."""

    def __init__(self, path: str):
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.fast, self.special = None, []
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) \
                and model.get("type", "BPE") == "BPE" and not spec.get("normalizer") \
                and not model.get("ignore_merges") and not model.get("dropout"):
            self.special = [x["content"] for x in spec.get("added_tokens", [])]
            code = _byte_of_char()
            ranks = {bytes(code[c] for c in token): i for token, i in model["vocab"].items()
                     if token not in self.special}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            ids = [model["vocab"][a + b] for a, b in pairs]
            if ids == sorted(ids) and len(ids) + 256 == len(ranks):
                import tiktoken
                self.fast = tiktoken.Encoding(
                    "file", mergeable_ranks=ranks, special_tokens={},
                    pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if self.fast is None or any(s in text for s in self.special):
            ids = self.tok.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.asarray(ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------------------
# Packing
# ---------------------------------------------------------------------------

class Packer:
    """Cuts a stream of token runs into pieces of sequences of ``length`` ids."""

    def __init__(self, length: int, first_sequence: int):
        self.length, self.sequence, self.used = length, first_sequence, 0
        self.open: list[tuple] = []              # pieces of the open sequence: doc, start, bytes, doc tokens

    def add(self, doc, ids: bytes) -> list[tuple]:
        """Pieces of the sequences that ``ids`` of one document fills."""
        out, n, at = [], len(ids) // 4, 0
        while at < n:
            take = min(n - at, self.length - self.used)
            self.open.append((doc, at, ids[4 * at:4 * (at + take)], n))
            self.used += take
            at += take
            if self.used == self.length:
                out += self._close()
        return out

    def _close(self) -> list[tuple]:
        out, at = [], 0
        for doc, start, ids, n in self.open:
            out.append((doc, start, len(ids) // 4, ids, n, self.sequence, at))
            at += len(ids) // 4
        self.sequence, self.used, self.open = self.sequence + 1, 0, []
        return out

    def finish(self) -> list[tuple]:
        """The rest, as sequences whose lengths are powers of two."""
        rest, self.open, left, out = self.open, [], self.used, []
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            while size:
                doc, start, ids, n = rest.pop(0)
                take = min(size, len(ids) // 4)
                self.open.append((doc, start, ids[:4 * take], n))
                if take < len(ids) // 4:
                    rest.insert(0, (doc, start + take, ids[4 * take:], n))
                size -= take
            out += self._close()
        return out


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 1024, separator: int = 0,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences (``PIECES``): ``ids`` holds the piece's ids as
    little-endian unsigned 32-bit numbers, ``start`` the ids of its document
    before it, ``offset`` its place in the sequence."""
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("_key", curve_key("text"))
    ordered = rows.repartitionByRange("_key", "doc_id").sortWithinPartitions("_key", "doc_id", "text")

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                            ("offset", pa.int64())])
        encode = encoder(tokenizer_path)
        end = np.asarray([separator], "<u4").tobytes()
        packer = Packer(length, TaskContext.get().partitionId() << 40)

        def rows_of(pieces):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*pieces), schema, strict=True)],
                                              schema=schema)
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                got = packer.add(b.column(0)[i].as_py(), encode(b.column(1)[i].as_py()) + end)
                held += got
                size += sum(4 * p[2] for p in got)
                if size > 4 << 20:
                    yield rows_of(held)
                    held, size = [], 0
        held += packer.finish()
        if held:
            yield rows_of(held)

    return ordered.select("doc_id", "text").mapInArrow(pack, PIECES)
