"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolake.llm import bpe_automaton, collocations, decontaminate, language_id, lattice_lm, pii_pseudonyms, resampling, secret_scan, sharding, simhash, simhash_dedup, toxicity, warc
from hydrolake.llm.common import read_table, shared_table, spread


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit with the next one."""
    return simhash.report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document by its text's bytes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", sharding.text_bytes("text").alias("bytes"))
    return sharding.assign(docs, F.col("doc_id"), F.col("bytes")).select("doc_id", "shard", "depth", "shard_bytes", "shard_rows")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in every document."""
    return decontaminate.find(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), read_table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return secret_scan.digest(secret_scan.scan(docs))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return simhash_dedup.near_groups(docs).select("doc_id", simhash_dedup.hex64("fp").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from four of five folds."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(language_id.fold(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    scored = toxicity.score(spread(docs), toxicity.learn(docs, labels))
    return scored.select("doc_id", (language_id.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to token ids and decoded again."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    coded = bpe_automaton.encode(docs, bpe_automaton.Tokenizer.load(tokenizer_path("word_bpe_49k.json")), ["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two of three folds."""
    raw = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(raw.filter(language_id.fold(F.col("doc_id"), 3) != 1))
    found = language_id.identify(spread(raw), model, ["doc_id"])
    return found.select("doc_id", (language_id.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str, key: bytes = b"example key; deployments pass their own") -> DataFrame:
    """Every document with its personal numbers, dates and addresses replaced."""
    return pii_pseudonyms.pseudonymise(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), key)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = shared_table(warc.write_archives(warc.plan_revisits(pages), warc.dictionary(warc.sample(pages))), "warc")
    return warc.read_archives(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first collocations of every language."""
    return collocations.mine(spread(read_table(spark, sf_dir, "documents").select("lang", "text")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rank in a draw towards the benchmark's texts."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return resampling.resample(docs, read_table(spark, sf_dir, "benchmark").select("text"))


def op13_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document, learned from nine of ten folds."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = (language_id.fold(F.col("doc_id"), 10) == 0).alias("held")
    return lattice_lm.score(docs, held, lattice_lm.Pieces.load(tokenizer_path("piece_bpe_32k.model")))


QUERIES = (op1_simhash, op2_sharding, op3_decontaminate, op4_secret_scan, op5_simhash_dedup, op6_toxicity, op7_bpe_automaton, op8_language_id, op9_pii_pseudonyms, op10_warc, op11_collocations, op12_resampling, op13_lattice_lm)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.oracle("documents", "doc_id", "text"), "op3_decontaminate": decontaminate.oracle(), "op11_collocations": collocations.oracle()}
