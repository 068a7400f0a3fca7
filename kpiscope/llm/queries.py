"""The ``opN_*`` queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiscope.llm import ann_anisotropic, blob_ledger, bpe_segment, cross_align, entropy_mix, page_diff, phrase_mining, pii_crf, quality_cnn, simhash_tiles, suffix_decontam, token_packing, url_cascade
from kpiscope.llm.common import table
from kpiscope.llm.sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The vocabulary file's path on each machine; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Longest fitting rule first decides; see the README for their origin.
URL_RULES = (
    url_cascade.Rule("allow", "com", "/"),
    url_cascade.Rule("block", "example.com", "/en/"),
    url_cascade.Rule("allow", "www.example.com", "/en/"),
    url_cascade.Rule("block", "net", "/es/"),
    url_cascade.Rule("block", "net", "/fr/"),
)
#: Sites that are blocked, with their subdomains, where no rule fits.
BLOCKED_SITES = tuple(
    f"{name}.example.{top}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for top in ("com", "net", "org")
)


def op1_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_SITES)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii_crf.scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return got.select(
        "doc_id", *map(count, pii_crf.KINDS),
        F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"),
    )


def op3_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_packing.write_shards(table(spark, sf_dir, "documents"), vocabulary(), end_id=0)
    return token_packing.read_digests(spark, path)


def op4_bpe_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_segment.encode_documents(docs, vocabulary(), ids=None, digests=True)


QUALITY_THRESHOLD = 0.3


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    got = quality_cnn.score(docs, network)
    return got.select(
        "doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op6_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = simhash_tiles.near_duplicates(docs, words=4, radius=4, min_similarity=None)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_ann_anisotropic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_anisotropic.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op8_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op9_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = blob_ledger.update_ledger(docs)
    got = blob_ledger.findings(docs, blob_ledger.read_ledger(spark, path))
    base = [r.kind for r in blob_ledger.BASE_RULES]

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    return got.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(blob_ledger.span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        blob_ledger.span_text(F.col("spans")).alias("spans"),
    )


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine(table(spark, sf_dir, "documents"))


def op12_cross_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = cross_align.align(table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model")).documents
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = entropy_mix.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_url_cascade": op1_url_cascade,
        "op2_pii_crf": op2_pii_crf,
        "op3_token_packing": op3_token_packing,
        "op4_bpe_segment": op4_bpe_segment,
        "op5_quality_cnn": op5_quality_cnn,
        "op6_simhash_tiles": op6_simhash_tiles,
        "op7_ann_anisotropic": op7_ann_anisotropic,
        "op8_page_diff": op8_page_diff,
        "op9_suffix_decontam": op9_suffix_decontam,
        "op10_blob_ledger": op10_blob_ledger,
        "op11_phrase_mining": op11_phrase_mining,
        "op12_cross_align": op12_cross_align,
        "op13_entropy_mix": op13_entropy_mix,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
