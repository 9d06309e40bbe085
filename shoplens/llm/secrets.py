"""Secrets in texts: patterned spans and high-entropy strings.

Patterned spans (kept as found): ``assign`` (a password-like name with a value
of at least 6 characters), ``access`` (key ids that start with AKIA, at least
20 characters), ``hex`` (runs of at least 24 lower-case hex digits); each kind
leftmost and non-overlapping, a failing match is dropped without a retry.

Entropy spans (``entropy``): patterned spans, UUIDs and labelled digests are cut
out of the maximal runs of token characters; what is left in pieces of at least
``min_length`` is scored. A window of ``window`` characters slides over a
candidate; its Shannon entropy is kept up to date from character counts (one
in, one out). A candidate is a secret when the largest window entropy reaches
the threshold of its character class (hex digits; digits with lower case, upper
case or both; letters of both cases) and no allow-list entry matches it. Letters
of one case alone, and digits alone, are taken for words and numbers. The
candidate is the whole piece if that is hex or has digits and both cases;
else, or if it is no secret as a whole, each stretch of neighbouring parts
(between / = _ -) that no allow-list entry matches, with the short word that
names its kind in front (``key-``).

Defined cases: null or empty text has no spans; offsets are code points, end
exclusive; repeated rows are scanned alike; an empty table gives an empty
result; other columns are carried along.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import char_starts, doc_chunks, fresh

KINDS = ("assign", "access", "hex", "entropy")
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.I | re.A)
# Bits a character a window must reach, by class, and the length from which the class counts.
THRESHOLDS = {"hex": (3.1, 24), "mixed": (3.7, 20), "lower": (3.4, 20), "upper": (3.4, 20), "letters": (3.7, 20)}


_WORD = re.compile(r"[A-Z]?[a-z]++|[A-Z]++")
_PLACE = re.compile(r"[0-9]*+|[vV][0-9]{1,3}|[0-9]{4}Q[1-4]|[0-9]{8}T[0-9]{4,6}Z?")


def reads_as_words(s: str) -> bool:
    """Letters and digits that read as words: numbered words of one case; or,
    cut where the case changes and at numbers, words of four letters or more on
    average, with at most one number a word and a third as many digits as letters."""
    if re.fullmatch(r"[A-Z]?[a-z]++[0-9]{0,4}|[A-Z]++[0-9]{0,4}", s):
        return True
    if not re.fullmatch(r"[A-Za-z0-9]+", s) or not (re.search("[a-z]", s) and re.search("[A-Z]", s)):
        return False
    words = _WORD.findall(re.sub(r"([A-Z][a-z])", r" \1", s))
    numbers = re.findall("[0-9]++", s)
    letters = sum(map(len, words))
    return letters >= 4 * len(words) and len(numbers) <= len(words) and 3 * sum(map(len, numbers)) <= letters


def identifier(s: str) -> bool:
    """Identifiers and paths: between / = _ + - lie words (``reads_as_words``),
    numbers, versions, quarters and time stamps; other parts have at most eight
    characters each and together at most a fifth as many as the words."""
    words, rest = 0, []
    for part in re.split(r"[-_/=+]+", s):
        if reads_as_words(part):
            words += len(part)
        elif not _PLACE.fullmatch(part):
            rest.append(len(part))
    return 5 * sum(rest) <= words and max(rest, default=0) <= 8


def _path(*words: str) -> str:
    """Words of the given forms joined by single signs; possessive, so linear."""
    word = "(?:" + "|".join(words) + ")"
    return rf"^{word}(?:[-_/=+]{word})*+[-_/=+]?$"


# Regular expressions (searched) and functions.
ALLOW = (r"(?i)example|placeholder|changeme|x{6}|\*{4}",                # documentation values
         _path("[A-Z]?[a-z]++", "[A-Z]++"), r"^[0-9+/_=-]+$",           # words, numbers, paths of words
         _path("[a-z]++[0-9]{0,4}+", "[0-9]++"), _path("[A-Z]++[0-9]{0,4}+", "[0-9]++"),    # and of numbered words
         identifier)
# No part of a candidate: UUIDs, and digests (hex or base64) behind their names.
PLAIN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|(?i:"
                   r"md5[-_/=+](?:[0-9a-f]{32}|[a-z0-9+/_-]{22})|sha1[-_/=+](?:[0-9a-f]{40}|[a-z0-9+/_-]{27})|"
                   r"sha256[-_/=+](?:[0-9a-f]{64}|[a-z0-9+/_-]{43}))={0,2})(?![0-9A-Za-z])")


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_DIG, _LOW = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UP = _LOW.upper()
_IS = {"hex": _table(_DIG + "abcdef"), "access": _table(_UP + _DIG), "token": _table(_UP + _LOW + _DIG + "+/_=-"),
       "sign": _table(":=")}


def window_entropy(s: str, window: int) -> float:
    """Largest Shannon entropy (bits a character) of the windows of ``s``.

    Counts change by one character in and one out; so does sum(c log c)."""
    n = min(window, len(s))
    if n == 0:
        return 0.0
    count: dict[str, int] = {}
    part = lambda c: c * math.log2(c) if c > 1 else 0.0
    total = 0.0

    def change(ch: str, by: int) -> None:
        nonlocal total
        c = count.get(ch, 0)
        total += part(c + by) - part(c)
        count[ch] = c + by
    for ch in s[:n]:
        change(ch, 1)
    best = math.log2(n) - total / n
    for i in range(n, len(s)):
        change(s[i], 1)
        change(s[i - n], -1)
        best = max(best, math.log2(n) - total / n)
    return best


def char_class(s: str) -> str | None:
    """Name of the threshold that holds for ``s``; None for letters of one case and for digits."""
    digit, low, up = (re.search(c, s) is not None for c in ("[0-9]", "[a-z]", "[A-Z]"))
    if digit and re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hex"
    if digit:
        return "mixed" if low and up else "lower" if low else "upper" if up else None
    return "letters" if low and up else None


def entropy_score(s: str, window: int = 20, thresholds=None, allow=ALLOW) -> float | None:
    """Largest window entropy if ``s`` passes its class's threshold and no
    allow-list pattern matches, else None."""
    thresholds = thresholds or THRESHOLDS
    if any(p(s) if callable(p) else re.search(p, s) for p in allow):
        return None
    kind = char_class(s)
    if kind not in thresholds:
        return None
    bits, least = thresholds[kind]
    e = window_entropy(s, window)
    return e if len(s) >= least and e >= bits else None


def entropy_spans(s: str, cuts=(), window: int = 20, min_length: int = 20) -> list[tuple[int, int, float]]:
    """(start, end, score) of the secrets of a run of token characters; ``cuts``
    are its patterned spans, in order and apart."""
    out, pieces, at = [], [], 0
    for a, b in [*cuts, (len(s), len(s))]:
        for m in PLAIN.finditer(s, at, a):
            pieces.append((at, m.start()))
            at = m.end()
        pieces.append((at, a))
        at = b
    for a, b in pieces:
        while a > 0 and a < b and s[a] in "/=_-":        # joints to what was cut out
            a += 1
        while b < len(s) and a < b and s[b - 1] in "/=_-":
            b -= 1
        if b - a < min_length:
            continue
        score = entropy_score(s[a:b], window) if char_class(s[a:b]) in ("hex", "mixed") else None
        if score is not None:
            out.append((a, b, score))
            continue
        stretches: list[list[int]] = []
        follows = False
        for m in re.finditer(r"[^/=_-]+", s[a:b]):
            if any(p(m[0]) if callable(p) else re.search(p, m[0]) for p in ALLOW):
                follows = False
            elif follows:
                stretches[-1][1] = a + m.end()
            else:
                stretches.append([a + m.start(), a + m.end()])
                follows = True
        for x, y in stretches:
            if re.fullmatch("={1,2}", s[y:b]):               # base64 padding
                y = b
            score = entropy_score(s[x:y], window) if y - x >= min_length else None
            if score is not None:
                name = re.search(r"(?<![A-Za-z0-9+])[A-Za-z]{1,8}[-_]$", s[max(a, x - 10):x])
                out.append((x - len(name[0]) if name else x, y, score))
    return out


def _runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``mask`` of ``least`` or more, cut at documents."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], mask))[:-1]
    start = np.flatnonzero(mask & (~before | edge[:-1]))
    after = np.concatenate((mask[1:], [False]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


def _apart(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover, in order."""
    starts, ends = [], []
    for a, _, b, _ in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scan_chunk(data: np.ndarray, off: np.ndarray, window: int = 20, min_length: int = 20
               ) -> list[list[tuple[int, int, int, float]]]:
    """Spans (start, kind number, end, score) of each document of a chunk, in order."""
    out: list[list] = [[] for _ in range(len(off) - 1)]
    if not len(data):
        return out
    chars = char_starts(data)
    raw = data.tobytes()

    def put(doc: int, kind: int, s: int, e: int, score: float) -> None:
        at = chars[off[doc]]
        out[doc].append((int(chars[s] - at), kind, int(chars[e] - at), score))
    signs = np.flatnonzero(_IS["sign"][data])
    for doc in np.unique(np.searchsorted(off, signs, "right") - 1):
        text = raw[off[doc]:off[doc + 1]].decode("utf-8", "replace")
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                out[doc].append((m.start(), 0, m.end(), 1.0))
    s, e = _runs(_IS["access"][data], off, 20)
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        at = raw.find(b"AKIA", a, b)
        if at >= 0 and b - at >= 20:
            put(int(np.searchsorted(off, a, "right")) - 1, 1, at, b, 1.0)
    s, e = _runs(_IS["hex"][data], off, 24)
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        put(int(np.searchsorted(off, a, "right")) - 1, 2, a, b, 1.0)
    s, e = _runs(_IS["token"][data], off, min_length)
    known: dict[int, tuple[list, list]] = {}
    for a, b in zip(s.tolist(), e.tolist(), strict=True):
        doc = int(np.searchsorted(off, a, "right")) - 1
        if doc not in known:
            known[doc] = _apart(out[doc])
        starts, ends = known[doc]
        lo = int(chars[a] - chars[off[doc]])
        n, cuts = b - a, []
        for i in range(bisect_right(ends, lo), bisect_left(starts, lo + n)):
            cuts.append((max(starts[i] - lo, 0), min(ends[i] - lo, n)))
        for x, y, score in entropy_spans(raw[a:b].decode(), cuts, window, min_length):
            out[doc].append((lo + x, 3, lo + y, round(score, 6)))
    for spans in out:
        spans.sort()
    return out


def find_secrets(text: Column | str, window: int = 20, min_length: int = 20) -> Column:
    """Column of spans (kind, start, end, score), by start, then kind as listed."""
    @F.arrow_udf(SPANS)
    def scan(texts):
        import pyarrow as pa
        rows = []
        for _, _, data, off in doc_chunks(None, texts):
            rows += [[{"kind": KINDS[k], "start": s, "end": e, "score": w} for s, k, e, w in spans]
                     for spans in scan_chunk(data, off, window, min_length)]
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        return pa.array(rows, pa.list_(item))

    return scan(text)


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every stretch covered by spans replaced once by ``mask``.

    Overlapping spans count as one stretch. Null text stays null."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, zero, lambda acc, x: F.struct(
        F.greatest(acc["at"], x["end"]).alias("at"),
        F.when(x["start"] >= acc["at"],
               F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")),
                        F.lit(mask)))
        .otherwise(acc["out"]).alias("out")))
    cut = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, cut).otherwise(text)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with secrets masked and, where present, the length column
    brought up to date; every row is kept."""
    spans, new = fresh(docs, "_spans", "_new")
    out = docs.withColumn(spans, find_secrets(text_col))
    out = out.withColumn(new, redact(F.col(text_col), F.col(spans)))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(new).alias(c))
        elif c == chars_col:
            cols.append(F.when(F.size(spans) > 0, F.length(new).cast("long")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
