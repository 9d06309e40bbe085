"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm import ann, licenses, minhash, mixing, packing, phrases, pii, prefix_trie, quality, secrets, \
    suffix_dedup, toxicity, warc
from shoplens.llm.common import read_table, stage_table
from shoplens.llm.oracle import ORACLE_SQL  # noqa: F401


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _span_digest(df: DataFrame, spans: str, base: tuple[str, ...]) -> DataFrame:
    s = F.col(spans)
    listed = F.filter(s, lambda x: x["kind"].isin(*base))
    counts = [F.size(F.filter(s, _of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    return df.select("doc_id", *counts, F.sha2(_joined(listed), 256).alias("base_sha256"), _joined(s).alias("spans"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive round trip of every page."""
    back = warc.roundtrip(read_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digest(docs.select("doc_id", pii.find_pii("text").alias("s")), "s", pii.BASE_KINDS)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: 2-word shingles, 0.8 or more."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = minhash.components(docs, k=2, percent=80)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


MIX_LEVELS = ("domain", "lang", "source")
MIX_DOMAINS = 4


def mix_weights() -> dict[str, Column]:
    """Target weights of the production mix, whole numbers per node of a level."""
    lang, domain = F.col("lang"), F.col("domain")
    return {"domain": F.when(domain == "d0", 4).when(domain == "d1", 3).when(domain == "d2", 2).otherwise(1),
            "lang": F.when(lang == "en", 5).when(lang.isin("de", "fr"), 2).otherwise(1)}


def domain_of(source: Column) -> Column:
    """Domain of a source; sources are dealt to domains by a checksum of their name."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(MIX_DOMAINS)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, mixed to the target weights from at most two epochs a leaf."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source",
        mixing.count_tokens("text").alias("tokens"))
    docs = stage_table(docs, "mix_docs")
    made = mixing.plan(docs, MIX_LEVELS, 0.5, mix_weights())
    return mixing.take(docs, made, MIX_LEVELS)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return _span_digest(docs.select("doc_id", secrets.find_secrets("text").alias("s")), "s",
                        ("assign", "access", "hex"))


def tokenizer_path() -> str:
    """Place of the production tokenizer file on this machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 1024 ids."""
    pieces = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and posterior verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = stage_table(docs.select("doc_id", quality.count_text("text").alias("_q")), "quality")
    model = quality.fit_votes(quality.vote_table(stats))
    p = quality.posterior(model)
    return stats.select("doc_id", *[F.col(f"_q.{c}").alias(c) for c in quality.COUNTS[:5]],
                        quality.base_failed().alias("base_failed"),
                        (~quality.base_failed() & (p >= 0.5)).alias("kept"), F.round(p, 6).alias("p_quality"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License passages of every document."""
    return licenses.find_licenses(read_table(spark, sf_dir, "documents"))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document less its 50-byte strings of earlier documents."""
    out = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest found of every vector whose id is divisible by 100."""
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


HELD_OUT = 2


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.learn_chain(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"),
                                 lambda i: toxicity.remainder(i) != HELD_OUT)
    out = toxicity.score_documents(docs, chain)
    return out.select("doc_id", F.coalesce(toxicity.remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
                      "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


QUERIES = {"op1_warc": op1_warc, "op2_pii": op2_pii, "op3_minhash": op3_minhash,
           "op4_mixing": op4_mixing, "op6_packing": op6_packing,
           "op5_secrets": op5_secrets, "op7_quality": op7_quality, "op8_licenses": op8_licenses,
           "op9_suffix": op9_suffix, "op10_ann": op10_ann,
           "op11_phrases": op11_phrases, "op12_prefix_trie": op12_prefix_trie,
           "op13_toxicity": op13_toxicity}
