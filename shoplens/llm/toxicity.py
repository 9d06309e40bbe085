"""Toxic spans by a linear-chain conditional random field.

Documents are labelled, words are not, so labelled words come first: over all
labelled training documents each feature of a word (the word itself, its
beginnings of 3 to 8 bytes) is counted in toxic and in other documents, copies
of one text counting as one. A feature whose share of toxic documents is too
high for chance (the likelihood ratio beyond the logarithm of the number of
features) marks its words in toxic documents as toxic words. A chain of two
states with these features is fitted to the marked words of a bounded sample
(``SAMPLE`` documents of either label) by its gradient, words expected by
forward-backward against words marked. Forward-backward marginals then tag the
words of every document; their sum, the expected number of toxic words, gives
the document's score by a logistic curve fitted to the same sample, and words
beyond one half give the offending offsets.

Chains of any length are cut into blocks whose 2 x 2 transfer matrices are
multiplied for all blocks at once, so a text of a million words takes a few
thousand vector steps. Nothing but the text enters a score.

Cases: null and empty texts have no words and get the score of no toxic word;
documents without an id are scored, never learned from; labels that are null
are ignored, of several labels of a document the largest holds; without
labelled documents of both kinds every score is the share of toxic labels
(0 without any). Repeated rows, ties, very long texts, an empty table and
columns of any other name need no special treatment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import LOWER, char_starts, doc_chunks, mix64, prefix_hash, range_hash, stage_table

BEGINNINGS = (3, 4, 5, 6, 7, 8)
SAMPLE = 600                 # training documents of either label that the chain is fitted to
SAMPLE_BYTES = 32 << 20      # and their text altogether
MAX_FEATURES = 20_000        # features of the chain, the most significant ones
MARGIN = 3.0                 # likelihood ratio beyond the logarithm of the number of features
ROUNDS, RATE, L2 = 80, 0.3, 0.02
TOXIC_WORD = 0.5
FLOOR = 0.5                  # added to the expected number before its logarithm is taken: what lies well below is alike

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[128:] = True
for _r in (range(48, 58), range(65, 91), range(97, 123)):
    _WORD_BYTE[list(_r)] = True
_KIND = {k: np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)) for k in (0, *BEGINNINGS)}
_BITS = np.uint64(44)        # 20 bits of a feature choose its place in the model's bitmap


# ---------------------------------------------------------------------------
# words and features
# ---------------------------------------------------------------------------

def lower_case(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of UTF-8 text in lower case."""
    out = LOWER[data]
    if len(data) > 1:
        at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[at] += 32
    return out


def split_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of runs of letters and digits."""
    inside = _WORD_BYTE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(off[1:] > off[:-1])
    start[off[full]] = inside[off[full]]
    end[off[full + 1] - 1] = inside[off[full + 1] - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, feature hashes) of each kind: the word, its beginnings."""
    prefix = prefix_hash(lower_case(data))
    yield np.arange(len(start)), mix64(range_hash(prefix, start, end) ^ _KIND[0])
    for n in BEGINNINGS:
        long = np.flatnonzero(end - start > n)
        yield long, mix64(range_hash(prefix, start[long], start[long] + n) ^ _KIND[n])


def _signatures(batches: Iterator) -> Iterator:
    """(doc_id, signature): the smallest hash of three neighbouring words, which near copies mostly share."""
    import pyarrow as pa
    for batch in batches:
        sig = np.zeros(batch.num_rows, np.int64)
        for i, j, data, off in doc_chunks(None, batch.column(1)):
            start, end, doc = split_words(data, off)
            h = range_hash(prefix_hash(LOWER[data]), start, end)
            for n in (1, 3):                                # texts of fewer than three words: their smallest word
                if len(h) >= n:
                    x = h if n == 1 else mix64(h[:-2] + mix64(h[1:-1] + mix64(h[2:])))
                    same = np.flatnonzero(doc[:len(x)] == doc[n - 1:])
                    low = np.full(j - i, 2**64 - 1, np.uint64)
                    np.minimum.at(low, doc[same], x[same])
                    seen = np.unique(doc[same])
                    sig[i + seen] = low[seen].view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig)], ["doc_id", "sig"])


STATISTIC = "feature long, toxic double, other double"


def _statistics(batches: Iterator, held: int = 1 << 21) -> Iterator:
    """(feature, weight of toxic documents, weight of others) over (text, toxic, weight), added up per few megabytes."""
    import pyarrow as pa
    parts: list[np.ndarray] = []
    rows = 0

    def summed() -> np.ndarray:
        every = np.concatenate(parts)
        keys, place = np.unique(every["f"], return_inverse=True)
        out = np.zeros(len(keys), every.dtype)
        out["f"] = keys
        for c in ("t", "o"):
            out[c] = np.bincount(place, weights=every[c], minlength=len(keys))
        return out

    def batch_of(x: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(x["f"].view(np.int64)), pa.array(x["t"]), pa.array(x["o"])],
                                          ["feature", "toxic", "other"])
    for batch in batches:
        toxic, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        for i, j, data, off in doc_chunks(None, batch.column(0)):
            start, end, doc = split_words(data, off)
            for word, h in features(data, start, end):
                order = np.lexsort((h, doc[word]))
                d, h = doc[word][order], h[order]
                if not len(h):
                    continue
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
                d, h = d[new] + i, h[new]
                x = np.zeros(len(h), [("f", np.uint64), ("t", np.float64), ("o", np.float64)])
                x["f"], x["t"], x["o"] = h, np.where(toxic[d] > 0, weight[d], 0), np.where(toxic[d] > 0, 0, weight[d])
                parts.append(x)
                rows += len(x)
            if rows >= held:
                parts = [summed()]
                rows = 0 if len(parts[0]) < held else held
                if rows:
                    yield batch_of(parts[0])
                    parts, rows = [], 0
    if parts:
        yield batch_of(summed())


# ---------------------------------------------------------------------------
# the chain
# ---------------------------------------------------------------------------

@dataclass
class Chain:
    """Two states, 0 and 1 (toxic). ``weights`` of the sorted ``keys`` and the
    bias add up to a word's log-odds; ``moves`` and ``first`` are logarithms of
    transitions and of first states; ``curve`` turns expected toxic words into
    a score. Without ``curve`` every score is ``share``."""
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    first: np.ndarray
    curve: tuple[float, float] | None = None
    share: float = 0.0

    def __post_init__(self):
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.keys >> _BITS).astype(np.int64)] = True

    def found(self, data, start, end) -> tuple[np.ndarray, np.ndarray]:
        """(word number, feature number) of every feature that the chain knows."""
        words, which = [], []
        for word, h in features(data, start, end):
            maybe = np.flatnonzero(self.bitmap[(h >> _BITS).astype(np.int64)])
            if len(maybe) and len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
                hit = self.keys[at] == h[maybe]
                words.append(word[maybe[hit]])
                which.append(at[hit])
        z = np.zeros(0, np.int64)
        return (np.concatenate(words), np.concatenate(which)) if words else (z, z)

    def marginals(self, odds: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        a, b = self.messages(odds, fresh)
        both = a * b
        return both[1] / both.sum(0)

    def messages(self, odds: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward messages (2, n), each column scaled. ``odds``:
        log-odds of every word; ``fresh``: whether a word opens a document."""
        n = len(odds)
        size = max(1, int(np.ceil(np.sqrt(n))))
        rows = -(-n // size)
        e = np.ones(rows * size)
        e[:n] = np.exp(np.clip(odds, -30, 30))
        s = np.ones(rows * size, bool)
        s[:n] = fresh
        move, first = np.exp(self.moves), np.exp(self.first)
        forward = _scan(e.reshape(rows, size), s.reshape(rows, size), move, first)
        # Backward: the message of a word is that of the next one through the next one's transfer matrix.
        e2, s2 = np.ones(rows * size), np.ones(rows * size, bool)
        e2[:n - 1], s2[:n - 1] = e[1:n], s[1:n]
        backward = _scan(e2[::-1].reshape(rows, size), s2[::-1].reshape(rows, size), move, first, back=True)
        return forward.reshape(2, -1)[:, :n], backward.reshape(2, -1)[:, ::-1][:, :n]


def _scan(e, s, move, first, back: bool = False) -> np.ndarray:
    """Messages of a sequence that lies row by row in ``e`` (odds of state 1)
    and ``s`` (a document begins): transfer matrices of whole rows by steps
    over the columns, the row starts one after the other, then all messages."""
    rows, size = e.shape

    def step(x, y, l):
        if back:                                            # x_i = sum over j of move_ij e_j y_j, one at a document's end
            w = y * e[:, l]
            p = np.where(s[:, l], first[0] * x + first[1] * w, move[0, 0] * x + move[0, 1] * w)
            q = np.where(s[:, l], first[0] * x + first[1] * w, move[1, 0] * x + move[1, 1] * w)
            return p, q
        p = np.where(s[:, l], (x + y) * first[0], x * move[0, 0] + y * move[1, 0])
        q = np.where(s[:, l], (x + y) * first[1], x * move[0, 1] + y * move[1, 1]) * e[:, l]
        return p, q

    one, none = np.ones(rows), np.zeros(rows)
    a, b, c, d = one, none, none, one                       # what comes of (1, 0) and of (0, 1)
    for l in range(size):
        (a, b), (c, d) = step(a, b, l), step(c, d, l)
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    x, y = np.empty(rows), np.empty(rows)
    x[0] = y[0] = 0.5
    for r in range(1, rows):
        p, q = x[r - 1] * a[r - 1] + y[r - 1] * c[r - 1], x[r - 1] * b[r - 1] + y[r - 1] * d[r - 1]
        x[r], y[r] = p / (p + q), q / (p + q)
    out = np.empty((2, rows, size))
    for l in range(size):
        x, y = step(x, y, l)
        x, y = x / (x + y), y / (x + y)
        out[0, :, l], out[1, :, l] = x, y
    return out


def fit_chain(texts: list[str], toxic: np.ndarray, weight: np.ndarray, keys: np.ndarray, totals: tuple[float, float],
              rounds: int = ROUNDS) -> Chain:
    """Fit the chain to a sample. ``keys``: the significant features, whose
    words in toxic documents are the toxic ones; ``totals``: weight of all
    training documents that are toxic and not, for the curve's base rate."""
    import pyarrow as pa
    chain = Chain(keys, np.full(len(keys), 1.0), -4.0, np.zeros((2, 2)), np.zeros(2), None, totals[0] / max(1e-9, sum(totals)))
    (_, _, data, off), = list(doc_chunks(None, pa.array(texts, pa.large_string()), 1 << 40, 1 << 40))
    start, end, doc = split_words(data, off)
    if not len(start) or not len(keys):
        return chain
    word, which = chain.found(data, start, end)
    y = np.zeros(len(start), bool)
    y[word] = True
    y &= toxic[doc] > 0
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    inner = np.flatnonzero(~fresh)
    w = weight[doc]
    scale = 1 / max(1.0, float((w * y).sum()))
    theta = np.concatenate((chain.weights, [chain.bias], chain.moves.ravel(), chain.first))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = len(keys)
    # Every word's counts but the toxic ones' are those of the mass of other words; one figure, once.
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), w[inner])
    seen_first = np.array([(w[fresh] * ~y[fresh]).sum(), (w[fresh] * y[fresh]).sum()])
    for t in range(1, rounds + 1):
        chain.weights, chain.bias = theta[:k], theta[k]
        chain.moves, chain.first = theta[k + 1:k + 5].reshape(2, 2), theta[k + 5:]
        odds = np.bincount(word, weights=chain.weights[which], minlength=len(start)) + chain.bias
        a, b = chain.messages(odds, fresh)
        p = a * b
        p = p / p.sum(0)
        gap = w * (y - p[1])
        move, e = np.exp(chain.moves), np.exp(np.clip(odds[inner], -30, 30))
        pair = np.array([[a[i, inner - 1] * move[i, j] * (e if j else 1) * b[j, inner] for j in (0, 1)] for i in (0, 1)])
        pair = pair / pair.sum((0, 1))
        grad = np.concatenate((np.bincount(which, weights=gap[word], minlength=k), [gap.sum()],
                               (seen - (pair * w[inner]).sum(-1)).ravel(),
                               seen_first - np.array([(w[fresh] * p[0][fresh]).sum(), (w[fresh] * p[1][fresh]).sum()])))
        grad = grad * scale - L2 * scale * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    chain.weights, chain.bias = theta[:k].copy(), float(theta[k])
    chain.moves, chain.first = theta[k + 1:k + 5].reshape(2, 2).copy(), theta[k + 5:].copy()
    odds = np.bincount(word, weights=chain.weights[which], minlength=len(start)) + chain.bias
    expected = np.bincount(doc, weights=chain.marginals(odds, fresh), minlength=len(texts))
    per = np.array([max(1e-9, weight[toxic == c].sum()) for c in (0, 1)])
    chain.curve = _logistic(np.log(expected + FLOOR), toxic, weight * (np.array(totals)[::-1] / per)[toxic])
    return chain


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """Weighted logistic regression with a small ridge (Newton steps); the slope is not negative."""
    a, b = 0.0, 1.0
    w = w / w.sum() * len(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum() - 0.1 * a, (w * (y - p) * x).sum() - 0.1 * b])
        r = w * p * (1 - p)
        h = np.array([[r.sum() + 0.1, (r * x).sum()], [(r * x).sum(), (r * x * x).sum() + 0.1]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + move[0], max(0.0, b + move[1])
    return float(a), float(b)


def _pack(chain: Chain) -> bytes:
    import pickle
    return pickle.dumps((chain.keys, chain.weights, chain.bias, chain.moves, chain.first, chain.curve, chain.share))


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def remainder(doc_id: Column, folds: int = 4) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column]) -> DataFrame:
    """(text, toxic, weight) of the labelled documents that may be learned
    from. Copies of one text (equal signature and label) weigh one together."""
    known = labels.where(F.col("toxic").isNotNull() & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    src = docs.select("doc_id", "text").where(learn(F.col("doc_id")))
    sigs = src.mapInArrow(_signatures, "doc_id long, sig long").join(known, "doc_id")
    size = sigs.groupBy("sig", "toxic").agg(F.count(F.lit(1)).alias("n"))
    weighed = sigs.join(size, ["sig", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(1 / F.col("n")).alias("weight"))
    return src.join(weighed, "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "weight")


def significant(rows: DataFrame, toxic: float, other: float, most: int = MAX_FEATURES) -> DataFrame:
    """Features whose share of toxic documents is beyond chance."""
    base = toxic / (toxic + other)
    counts = stage_table(rows.mapInArrow(_statistics, STATISTIC).groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where(F.col("toxic") >= 1), "word_features")
    n = F.col("toxic") + F.col("other")
    share = F.col("toxic") / n
    ratio = F.col("toxic") * F.log(share / base) + F.when(F.col("other") > 0, F.col("other") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    edge = float(np.log(max(1, counts.count()))) + MARGIN
    return counts.where((share > max(base, 0.5)) & (ratio > edge)).orderBy(F.desc(ratio), "feature").limit(most).select("feature")


def learn_chain(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column], sample: int = SAMPLE) -> Chain:
    """Fit to the labelled documents whose id ``learn`` admits."""
    import pickle
    rows = stage_table(training_rows(docs, labels, learn), "toxic_training")
    totals = {r["toxic"]: r["w"] for r in rows.groupBy("toxic").agg(F.sum("weight").alias("w")).collect() if r["toxic"] in (0, 1)}
    toxic, other = totals.get(1, 0.0), totals.get(0, 0.0)
    if not toxic or not other:
        z = np.zeros(0)
        return Chain(z.astype(np.uint64), z, 0.0, np.zeros((2, 2)), np.zeros(2), None, 1.0 if toxic else 0.0)
    keys = np.sort(np.array([r["feature"] for r in significant(rows, toxic, other).collect()], np.int64).view(np.uint64))
    some = None
    for label in (1, 0):
        part = rows.where(F.col("toxic") == label).orderBy(F.xxhash64("text"), "text").limit(sample)
        some = part if some is None else some.unionByName(part)

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa
        rows = [(t or "", y, w) for b in batches for t, y, w in zip(*(b.column(c).to_pylist() for c in range(3)))]
        size, some = {0: 0, 1: 0}, []
        for t, y, w in rows:
            size[y] += len(t.encode())
            if size[y] <= SAMPLE_BYTES // 2:
                some.append((t, y, w))
        made = fit_chain([t for t, _, _ in some], np.array([y for _, y, _ in some], int),
                         np.array([w for _, _, w in some], float), keys, (toxic, other))
        yield pa.RecordBatch.from_arrays([pa.array([_pack(made)], pa.binary())], ["model"])
    return Chain(*pickle.loads(some.coalesce(1).mapInArrow(fit, "model binary").first()["model"]))


SCORED = "score double, spans string"


def score_documents(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """All rows and columns, with ``score`` and ``spans`` (start:end of the
    toxic words, neighbours joined; code points, end exclusive). The text and
    the other columns pass through the workers as they are."""
    packed = _pack(chain)
    names = docs.columns

    def run(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa
        model = Chain(*pickle.loads(packed))
        for batch in batches:
            score = np.full(batch.num_rows, model.share)
            spans = [""] * batch.num_rows
            for i, j, data, off in doc_chunks(None, batch.column(names.index(text))):
                expected = np.zeros(j - i)
                start, end, doc = split_words(data, off)
                if len(start):
                    word, which = model.found(data, start, end)
                    odds = np.bincount(word, weights=model.weights[which], minlength=len(start)) + model.bias
                    p = model.marginals(odds, np.concatenate(([True], doc[1:] != doc[:-1])))
                    expected = np.bincount(doc, weights=p, minlength=j - i)
                    _write_spans(spans, i, data, off, start, end, doc, np.flatnonzero(p >= TOXIC_WORD))
                if model.curve:
                    a, b = model.curve
                    score[i:j] = 1 / (1 + np.exp(-np.clip(a + b * np.log(expected + FLOOR), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array(spans, pa.string())],
                                             [*names, "score", "spans"])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, {SCORED}")


def _write_spans(out: list[str], base: int, data, off, start, end, doc, hits: np.ndarray) -> None:
    """Runs of neighbouring toxic words of each document as one span each."""
    if not len(hits):
        return
    chars = char_starts(data)
    begins = np.concatenate(([True], (np.diff(hits) != 1) | (doc[hits[1:]] != doc[hits[:-1]])))
    first, last = hits[begins], hits[np.concatenate((begins[1:], [True]))]
    zero = chars[off[doc[first]]]
    for d, a, b in zip(doc[first].tolist(), (chars[start[first]] - zero).tolist(), (chars[end[last]] - zero).tolist()):
        out[base + d] += f"{',' if out[base + d] else ''}{a}:{b}"
