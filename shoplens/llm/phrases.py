"""Phrase collocations by set-oriented relational mining.

Relations, not candidates, drive the search. ``occurrences`` writes the
relation of all word occurrences, sorted by piece and position and cut into
chunks of whole documents of one language: a chunk is a row that holds the
codes of its occurrences in order and the words behind the codes. From then on
level k

1. group-counts its relation: each chunk states how often it holds each
   phrase, the statements of a phrase meet (at most one row a chunk, however
   frequent it is), are added up and kept if it occurs ``minimum`` times;
2. semi-joins the relation with those phrases: the statements that are kept go
   back to their chunks with the phrase's id, other occurrences leave the
   relation. Counting and choosing read one shuffle of the statements;
3. merge-joins what is left with itself on piece and adjacent position: an
   occurrence of k + 1 words is a frequent one of k words at p and another at
   p + 1. The result is written and is the next level's relation.

Every part of a frequent phrase is frequent, so nothing is lost. Phrases are
keyed by the pair of ids of their two overlapping parts; the id of a phrase is
the place (chunk and code) of the first statement about it. Keys are exact and
part of written tables: a hash only picks the part in which statements meet, no
task numbers anything.

Cases: a null text is empty, a null language is ``und``; texts without words,
repeated rows and null ids are ordinary input; an empty table gives an empty
result; a document longer than a chunk is a chunk of its own. Only the text
and language columns are read, so any further columns may have any name. Ties
are ranked by score, count and phrase in byte order, which is total within a
language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import LOWER, doc_chunks, mix64, stage_table
from shoplens.llm.suffix_dedup import by_part, pack, split_parts, unpack

CHUNK_BYTES = 8 << 20
PART_BITS = 13              # chunks of an input partition; partition and chunk number take 31 bits
ROWS_PER_SALT = 100_000
STATED = 1 << 21            # statements of a part
SCALE = 2_000_000

# 0: of a word, 1: between words, 2: between pieces
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2

RELATION = "lang string, chunk long, n long, codes binary, fresh binary, words array<string>, counts array<long>"
PACKED = "part long, chunk long, body binary"
KEPT = "at long, body binary, id array<long>, lefts array<long>, rights array<long>, a array<long>"
EXTENDED = "chunk long, n long, codes binary, lefts array<long>, rights array<long>, counts array<long>"


def words_of(data: np.ndarray, off: np.ndarray):
    """Arrow array of the lower-cased words of a chunk, in order, and whether
    each one opens a piece. Neither words nor pieces cross documents."""
    import pyarrow as pa
    kind = KIND[data]
    inside = kind == 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = np.flatnonzero(off[1:] > off[:-1])
    start[off[full]] = inside[off[full]]
    end[off[full + 1] - 1] = inside[off[full + 1] - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    cuts = np.cumsum(kind == 2, dtype=np.int32)
    doc = np.searchsorted(off, start, "right")
    fresh = np.ones(len(start), bool)
    fresh[1:] = (cuts[start[1:]] != cuts[start[:-1]]) | (doc[1:] != doc[:-1])
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    letters = LOWER[data[inside]]
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
    return words, fresh


def _packed(codes: np.ndarray) -> bytes:
    import pyarrow as pa
    return pa.compress(codes.tobytes(), "zstd", asbytes=True)


def _relation_rows(batches: Iterator, chunk_bytes: int) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()),
                        ("fresh", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    serial = TaskContext.get().partitionId() << PART_BITS
    last = serial + (1 << PART_BITS)
    held: dict[str, list] = {}
    size: dict[str, int] = {}

    def flush(lang: str):
        nonlocal serial
        for _, _, data, off in doc_chunks(None, pa.concat_arrays(held.pop(lang)), chunk_bytes, 1 << 40):
            words, fresh = words_of(data, off)
            if not len(words):
                continue
            if serial == last:
                raise ValueError("an input partition has too many chunks; read it in smaller partitions")
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int32)
            counts = np.bincount(codes, minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([serial], pa.int64()), pa.array([len(codes)], pa.int64()),
                 pa.array([_packed(codes)], pa.binary()), pa.array([np.packbits(fresh).tobytes()], pa.binary()),
                 pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary.cast(pa.string())),
                 pa.ListArray.from_arrays([0, len(counts)], pa.array(counts, pa.int64()))], schema=schema)
            serial += 1
        size.pop(lang)

    for batch in batches:
        langs, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        for lang in pc.unique(langs).to_pylist():
            mine = texts.filter(pc.equal(langs, lang))
            held.setdefault(lang, []).append(mine)
            size[lang] = size.get(lang, 0) + mine.nbytes
        while size and (max(size.values()) >= chunk_bytes or sum(size.values()) >= 2 * chunk_bytes):
            yield from flush(max(size, key=size.get))
    for lang in list(held):
        yield from flush(lang)


def occurrences(docs: DataFrame, text: str = "text", lang: str = "lang", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The relation of all word occurrences, a row a chunk of one language."""
    src = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(lambda it: _relation_rows(it, chunk_bytes), RELATION)


def _adjacent(relation, reply):
    """One chunk: its occurrences of frequent phrases, merge-joined with
    themselves on piece and adjacent position."""
    import pyarrow as pa
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("codes", pa.binary()),
                        *[(c, pa.list_(pa.int64())) for c in ("lefts", "rights", "counts")]])
    if relation.num_rows == 0 or reply.num_rows == 0:
        return schema.empty_table()
    row = relation.select(["chunk", "codes", "n", "size"] + [c for c in ("fresh",) if c in relation.column_names]).to_pylist()[0]
    codes = np.frombuffer(pa.decompress(row["codes"], 4 * row["n"], "zstd"), np.int32)
    ids = np.full(row["size"] + 1, -1, np.int64)                # the last place is that of code -1
    if "body" in reply.column_names:
        for body in reply.column("body").to_pylist():
            steps, phrases = unpack(body)
            ids[np.cumsum(steps, dtype=np.int64)] = phrases
    else:
        ids[reply.column("code").to_numpy()] = reply.column("id").to_numpy()
    left = (ids >= 0)[codes]
    both = left[:-1] & left[1:]
    if "fresh" in row:                                          # beyond one word the overlap lies in one piece
        both &= ~np.unpackbits(np.frombuffer(row["fresh"], np.uint8), count=len(codes)).astype(bool)[1:]
    at = np.flatnonzero(both)
    if not len(at):
        return schema.empty_table()
    size = row["size"]
    pairs, place, counts = np.unique(codes[at].astype(np.int64) * size + codes[at + 1], return_inverse=True, return_counts=True)
    out = np.full(len(codes), -1, np.int32)
    out[at] = place
    lists = [ids[pairs // size], ids[pairs % size], counts.astype(np.int64)]
    return pa.Table.from_arrays([pa.array([row["chunk"]], pa.int64()), pa.array([row["n"]], pa.int64()), pa.array([_packed(out)], pa.binary()),
                                 *[pa.ListArray.from_arrays([0, len(pairs)], pa.array(x)) for x in lists]], schema=schema)


def _longer(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases (id, lefts, rights, a) with their words and the counts of their
    prefixes (of 1, 2, ... words) and suffixes, from those of their two parts."""
    p = shorter.select(F.col("id").alias("lefts"), "lang", F.col("phrase").alias("_head"),
                       F.concat("pre", F.array("a")).alias("pre"))
    s = shorter.select(F.col("id").alias("rights"), "last", F.concat("suf", F.array("a")).alias("suf"))
    return found.join(p, "lefts").join(s, "rights").select(
        "id", "lang", F.concat_ws(" ", "_head", "last").alias("phrase"), "last", "a", "pre", "suf", "lefts", "rights")


def _statements(relation: DataFrame, *fields: str, also: tuple[str, ...] = ()) -> DataFrame:
    """A row a chunk and phrase: (place, *fields, cnt); the place is the chunk in its upper half, the code in its lower."""
    x = relation.select("chunk", *also, F.posexplode(F.arrays_zip(*fields, "counts")).alias("code", "x"))
    return x.select((F.shiftleft("chunk", 32) + F.col("code")).alias("place"), *also,
                    *[F.col(f"x.{c}").alias(c) for c in fields], F.col("x.counts").alias("cnt"))


def _frequent(statements: DataFrame, key: list[str], minimum: int, name: str) -> DataFrame:
    """The statements about phrases that occur ``minimum`` times, with the
    phrase's count and id; its key stands in its first statement alone."""
    w = Window.partitionBy(*key)
    kept = statements.withColumn("a", F.sum("cnt").over(w)).withColumn("id", F.min("place").over(w)).where(F.col("a") >= minimum)
    first = F.col("place") == F.col("id")
    at, code = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return stage_table(kept.select(at.alias("at"), code.alias("code"), "id", *[F.when(first, F.col(c)).alias(c) for c in (*key, "a")]), name)


def _stated_rows(bits: int):
    """The statements of chunks (chunk, lefts, rights, counts), dealt to 2**``bits`` parts by a hash of their phrase."""
    def run(batches):
        import pyarrow as pa
        shift = np.uint64(64 - bits)
        for b in batches:
            for i, chunk in enumerate(b.column(0).to_pylist()):
                lefts, rights, counts = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                if not len(lefts):
                    continue
                part = mix64(lefts.astype(np.uint64) ^ mix64(rights.astype(np.uint64))) >> shift
                order = np.argsort(part, kind="stable")
                parts, bodies = [], []
                for p, s in split_parts(part[order]):
                    code = order[s]
                    parts.append(p)
                    bodies.append(pack(np.diff(code, prepend=0).astype(np.uint32), lefts[code], rights[code], counts[code].astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([chunk] * len(parts), pa.int64()),
                                                  pa.array(bodies, pa.binary())], names=["part", "chunk", "body"])
    return run


def _kept_rows(minimum: int, replies: bool):
    """Of each part the statements about phrases that occur ``minimum`` times, a
    row a chunk: its codes and the ids of their phrases, packed (with
    ``replies`` alone), and the phrases that are first stated there."""
    def run(batches):
        import pyarrow as pa
        for held in by_part(batches):
            cols = [unpack(body) for _, body in held]
            place = np.concatenate([(chunk << 32) + np.cumsum(c[0], dtype=np.int64) for (chunk, _), c in zip(held, cols, strict=True)])
            lefts, rights, cnt = (np.concatenate([c[i] for c in cols]) for i in (1, 2, 3))
            order = np.lexsort((rights, lefts))
            place, lefts, rights = place[order], lefts[order], rights[order]
            heads = np.flatnonzero(np.concatenate(([True], (lefts[1:] != lefts[:-1]) | (rights[1:] != rights[:-1]))))
            size = np.diff(np.append(heads, len(place)))
            a = np.repeat(np.add.reduceat(cnt[order].astype(np.int64), heads), size)
            ids = np.repeat(np.minimum.reduceat(place, heads), size)
            use = np.flatnonzero((a >= minimum) & (replies | (place == ids)))
            if not len(use):
                continue
            use = use[np.argsort(place[use])]
            at, bodies, chunks, new = place[use] >> 32, [], [], place[use] == ids[use]
            ends = [0]
            for chunk, s in split_parts(at):
                chunks.append(chunk)
                code = place[use[s]] & 0xFFFFFFFF
                bodies.append(pack(np.diff(code, prepend=0).astype(np.uint32), ids[use[s]]) if replies else None)
                ends.append(ends[-1] + int(new[s].sum()))
            first = use[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), pa.array(bodies, pa.binary()),
                 *[pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[first])) for x in (ids, lefts, rights, a)]],
                names=["at", "body", "id", "lefts", "rights", "a"])
    return run


def _frequent_longer(relation: DataFrame, minimum: int, replies: bool, name: str) -> DataFrame:
    """As :func:`_frequent`, of the phrases of a relation of two words or more; rows as :func:`_kept_rows` makes them."""
    n = relation.agg(F.coalesce(F.sum(F.size("counts")), F.lit(0))).first()[0]
    bits = max(6, int(np.ceil(np.log2(max(1, n / STATED)))))
    stated = relation.select("chunk", "lefts", "rights", "counts").mapInArrow(_stated_rows(bits), PACKED)
    met = stated.repartition(1 << bits, "part").sortWithinPartitions("part")
    return stage_table(met.mapInArrow(_kept_rows(minimum, replies), KEPT), name)


def frequent_phrases(relation: DataFrame, minimum: int, longest: int) -> list[DataFrame]:
    """For k = 1 .. ``longest`` the table of phrases of k words that occur
    ``minimum`` times or more in their language: (id, lang, phrase, last, a, pre,
    suf, lefts, rights). ``relation``: the written :func:`occurrences`."""
    levels: list[DataFrame] = []
    none, no = F.array().cast("array<long>"), F.lit(None).cast("long")
    for k in range(1, longest + 1):
        kept = _frequent(_statements(relation, "words", also=("lang",)), ["lang", "words"], minimum, f"statements_{k}") if k == 1 \
            else _frequent_longer(relation, minimum, k < longest, f"statements_{k}")
        if k == 1:
            found = kept.where(F.col("a").isNotNull())
            levels.append(found.select("id", "lang", F.col("words").alias("phrase"), F.col("words").alias("last"), "a",
                                       none.alias("pre"), none.alias("suf"), no.alias("lefts"), no.alias("rights")))
        else:
            found = kept.select(F.explode(F.arrays_zip("id", "lefts", "rights", "a")).alias("x")).select("x.*")
            levels.append(stage_table(_longer(found, levels[-1]), f"phrases_{k}"))
        if k == longest:
            break
        held = relation.select("chunk", "n", "codes", F.size("counts").alias("size"), *(["fresh"] if k == 1 else []))
        relation = stage_table(held.groupBy("chunk").cogroup(kept.select("at", *(["code", "id"] if k == 1 else ["body"])).groupBy("at"))
                               .applyInArrow(_adjacent, EXTENDED), f"occurrences_{k + 1}")
    return levels


def weakest_cut(k: int, scale: int = SCALE) -> Column:
    """(score, k, l, r) of the cut of a phrase of ``k`` words that scores
    lowest, the first of equal ones. Whole numbers, products in 38 digits."""
    def cut(i: int) -> Column:
        l, r = F.element_at("pre", i), F.element_at("suf", k - i)
        wide = [c.cast("decimal(19,0)") for c in (F.col("a"), l, r)]
        score = F.call_function("div", wide[0] * F.lit(scale).cast("decimal(10,0)"), wide[1] + wide[2])
        return F.struct(score.alias("score"), F.lit(i).alias("k"), l.alias("l"), r.alias("r"))
    return F.array_min(F.array(*[cut(i) for i in range(1, k)]))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", minimum: int = 30, longest: int = 4,
                 absorb: int = 80, top: int = 2000, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``top`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is dropped if its words lie inside a longer candidate that has
    ``absorb`` percent of its occurrences. Only candidates one word longer
    need to be looked at: whatever longer one holds the phrase holds it inside
    a part of k + 1 words, which occurs at least as often."""
    relation = stage_table(occurrences(docs, text, lang, chunk_bytes), "occurrences_1")
    levels = frequent_phrases(relation, minimum, longest)
    kept = []
    for k in range(2, longest + 1):
        found = levels[k - 1]
        if k < longest:
            above = levels[k].select(F.explode(F.array_distinct(F.array("lefts", "rights"))).alias("id"), F.col("a").alias("_above")) \
                .groupBy("id").agg(F.max("_above").alias("_above"))
            wide = [F.col(c).cast("decimal(19,0)") for c in ("_above", "a")]
            found = found.join(above, "id", "left") \
                .where(F.col("_above").isNull() | (wide[0] * F.lit(100) < wide[1] * F.lit(absorb)))
        kept.append(found.select("lang", "phrase", "a", weakest_cut(k).alias("_cut")))
    found = stage_table(reduce(DataFrame.unionByName, kept), "candidates")
    total = relation.groupBy("lang").agg(F.sum("n").alias("n"))
    # The best of a language are the best of its salted parts: no language is one task's work.
    salts = max(1, -(-found.count() // ROWS_PER_SALT))
    best = [F.desc("_cut.score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    some = found.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best)))
    ranked = some.where(F.col("_r") <= top).withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*best))) \
        .where(F.col("_r") <= top)
    return ranked.join(total, "lang").select("lang", F.col("_r").cast("long").alias("rank"), "phrase", "a",
                                             F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n",
                                             F.col("_cut.score").cast("long").alias("score"))
