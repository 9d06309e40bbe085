"""Quality rules as weak supervision.

Each rule looks at counts of a text and votes good (+1), bad (-1) or abstains
(0). Expectation-maximisation over the table of vote patterns (at most
3**rules rows, so a bounded frame) estimates how often each rule votes what
on good and bad texts and the share of good ones; the posterior probability of
quality then replaces "all rules must pass".

The model is fitted on the vote counts of all documents. The posterior is a
sum of log ratios per vote, so applying it is a plain column expression.

Defined cases: null or empty text counts as no words, lines or characters and
fails the length base rule; repeated rows get the same verdict; with an empty
table the prior accuracies are used and the result is empty; other columns
are carried along.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import IS_SPACE, all_columns, doc_chunks, fresh, prefix_hash, range_hash, word_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters",
          "n_upper", "n_ends", "n_bare", "n_marked")
STATS = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL, _END = _table("#*$%&|<>"), _table(".!?")
_UPPER, _LOWER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz")
_PUNCT = _table("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_TAIL = _table("!#$%&*<>|~^=+")


def _repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Mask of the (doc, hash) entries that occur more than once."""
    key = (doc.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of every document of a chunk (at most 1024 documents)."""
    nd = len(off) - 1
    h, start, end, doc = word_hashes(data, off, lower=False)

    def per_doc(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[off[1:]] - total[off[:-1]]).astype(np.int64)

    def words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=nd).astype(np.int64)
    out = {"n_words": words(np.ones(len(doc), bool)),
           "word_chars": per_doc(((data & 0xC0) != 0x80) & ~IS_SPACE[data]), "n_symbols": per_doc(_SYMBOL[data])}
    # lines: split at \n within each document
    breaks = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate((off[:-1], breaks + 1)))
    ldoc = np.sort(np.concatenate((np.arange(nd), np.searchsorted(off, breaks, "right") - 1)))
    last = np.concatenate((ldoc[1:] != ldoc[:-1], [True])) if len(ldoc) else np.zeros(0, bool)
    le = np.where(last, off[ldoc + 1], np.concatenate((ls[1:], [0])) - 1)
    filled = np.concatenate(([0], np.cumsum(~IS_SPACE[data])))
    full = filled[le] > filled[ls]
    prefix = prefix_hash(data)
    key = (ldoc[full].astype(np.uint64) << np.uint64(54)) | (range_hash(prefix, ls[full], le[full]) >> np.uint64(10))
    key.sort()
    again = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.zeros(0, bool)
    out["n_dup_lines"] = np.bincount((key[again] >> np.uint64(54)).astype(np.int64), minlength=nd).astype(np.int64)
    out["n_lines"] = np.bincount(ldoc[full], minlength=nd).astype(np.int64)
    # words inside 3-word windows that occur at least twice in the text
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        odd = np.uint64(0xD6E8FEB86659FD93)
        tri = (h[:-2] * odd + h[1:-1]) * odd + h[2:]
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        at = inside[_repeats(doc[inside], tri[inside])]
        for i in range(3):
            covered[at + i] = True
    out["n_repeat_words"] = words(covered)
    out["n_letters"] = per_doc(_UPPER[data] | _LOWER[data])
    out["n_upper"] = per_doc(_UPPER[data])
    tail = data[end - 1] if len(end) else data[:0]
    out["n_ends"] = words(_END[tail])
    plain = np.concatenate(([0], np.cumsum(~_PUNCT[data])))
    out["n_bare"] = words(plain[end] == plain[start])             # words of punctuation only
    run = np.zeros(len(end), bool)
    two = end - start >= 2
    run[two] = _TAIL[data[end[two] - 1]] & _TAIL[data[end[two] - 2]]
    out["n_marked"] = words(run)                                   # words that end in two or more marks
    return out


def count_text(text: Column | str) -> Column:
    """Struct column of the counts (``COUNTS``) of each text."""
    @F.arrow_udf(STATS)
    def counts(texts):
        import pyarrow as pa
        parts = [text_counts(data, off) for _, _, data, off in doc_chunks(None, texts)]
        cols = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(COUNTS))

    return counts(text)


def _vote(bad: Column, good: Column | None = None) -> Column:
    v = F.when(bad, F.lit(-1))
    v = v if good is None else v.when(good, F.lit(1))
    return v.otherwise(F.lit(0)).cast("tinyint")


def votes(c) -> dict[str, Column]:
    """Rule name -> vote, from a function that gives a count's column.

    A rule that looks for one kind of damage votes bad or abstains: its silence
    says little. Only ``length`` and ``sentences`` also vote good."""
    w = c("n_words")
    return {
        "length": _vote(w < 50, (w >= 80) & (w <= 100_000)),
        "word_length": _vote((c("word_chars") < 2 * w) | (c("word_chars") > 14 * w)),
        "symbols": _vote(c("n_symbols") * 10 > w),
        "repeated_lines": _vote(c("n_dup_lines") * 10 > c("n_lines") * 3),
        "repeated_words": _vote(c("n_repeat_words") * 10 > w * 3),
        "capitals": _vote(c("n_upper") * 3 > c("n_letters")),
        "sentences": _vote((c("n_ends") * 200 < w) & (w >= 50), (c("n_ends") * 50 >= w) & (c("n_ends") * 2 <= w)),
        "bare_marks": _vote(c("n_bare") * 10 > w),
        "marked_words": _vote(c("n_marked") * 10 > w),
    }


RULES = ("length", "word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "sentences",
         "bare_marks", "marked_words")


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rules: int = len(RULES), rounds: int = 200,
              prior: float = 0.85, false_alarm: float = 0.01, hit: float = 0.4, strength: float = 0.05
              ) -> tuple[float, np.ndarray]:
    """EM on vote patterns: (log odds of good, log ratio[rule, vote + 1]).

    Votes are independent given the class; each rule has its own vote shares
    per class. A starting belief (a rule votes bad on ``false_alarm`` of good
    and ``hit`` of bad texts, and good the other way round) counts as
    ``strength`` of all texts, so the classes cannot trade places and rare
    votes keep finite weights."""
    base = np.empty((2, rules, 3))                       # class, rule, vote -1 / 0 / +1
    base[1], base[0] = [false_alarm, 0.5, 0.5], [hit, 0.6 - hit / 2, 0.4 - hit / 2]
    base /= base.sum(2, keepdims=True)
    theta, p = base.copy(), prior
    if patterns:
        v = np.array([x for x, _ in patterns]) + 1
        n = np.array([c for _, c in patterns], float)
        held = strength * n.sum() + 20.0
        hot = np.eye(3)[v]                               # pattern, rule, vote
        for _ in range(rounds):
            like = np.einsum("krv,crv->kc", hot, np.log(theta)) + np.log([1 - p, p])
            post = np.exp(like - like.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            got = np.einsum("k,kc,krv->crv", n, post, hot) \
                + held * np.array([1 - prior, prior])[:, None, None] * base
            new = got / got.sum(2, keepdims=True)
            p = float((n @ post[:, 1] + prior * held) / (n.sum() + held))
            moved = np.abs(new - theta).max()
            theta = new
            if moved < 1e-9:
                break
    return math.log(p / (1 - p)), np.log(theta[1] / theta[0])


def vote_table(stats: DataFrame, col: str = "_q") -> list[tuple[tuple[int, ...], int]]:
    """Distinct vote patterns with their counts: at most 3**rules rows."""
    v = votes(lambda c: F.col(f"{col}.{c}"))
    rows = stats.groupBy(*[v[r].alias(r) for r in RULES]).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((tuple(r[x] for x in RULES), r["n"]) for r in rows)


def posterior(model: tuple[float, np.ndarray], col: str = "_q") -> Column:
    """Probability of quality from a fitted model and the struct of counts."""
    odds, ratio = model
    v = votes(lambda c: F.col(f"{col}.{c}"))
    total = F.lit(float(odds))
    for i, r in enumerate(RULES):
        weights = F.array(*[F.lit(float(x)) for x in ratio[i]])
        total = total + F.get(weights, v[r].cast("int") + 1)
    return 1.0 / (1.0 + F.exp(-total))


def base_failed(col: str = "_q") -> Column:
    w = F.col(f"{col}.n_words")
    return (w < 50) | (F.col(f"{col}.n_repeat_words") * 100 > w * 50)


def fit(docs: DataFrame, text_col: str = "text"):
    """Model of the vote counts of all rows of ``docs``."""
    return fit_votes(vote_table(docs.select(count_text(text_col).alias("_q"))))


def keep_good(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules accept, columns unchanged."""
    q, = fresh(docs, "_q")
    model = fit(docs, text_col)
    out = docs.withColumn(q, count_text(text_col)).where(~base_failed(q) & (posterior(model, q) >= threshold))
    return out.select(*all_columns(docs))
