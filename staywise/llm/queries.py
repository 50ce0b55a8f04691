"""The thin named queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staywise.llm import (
    block_labeller,
    chat_log,
    collocations,
    decontaminate,
    disclosure,
    license_scan,
    mixing,
    ngram_join,
    oracles,
    prefix_trie,
    quality_rules,
    ring_shards,
    suffix_dedup,
    token_files,
)
from staywise.llm.common import QUERIES, query, table  # noqa: F401
from staywise.session import new_folder


def vocabulary(name: str) -> str:
    """The file of a public tokenizer; the vocabularies are an installed package on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_quality_rules", oracles.QUALITY)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_benchmark_decontamination", oracles.CONTAMINATION)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"))
    return token_files.token_index(spark, folder)


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.copies(mixing.with_size(table(spark, sf_dir, "documents")))
    each = mix.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("rows"))))  # equal rows were one item
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op9_ring_shards")
def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring_shards.assign(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op1_ngram_join", oracles.JOIN)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join_components(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op3_block_labeller")
def op3_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = block_labeller.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op4_chat_log", oracles.CHAT)
def op4_chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = F.array(*[F.struct(F.lit(-1).cast("long"), F.lit(k).cast("long"), F.lit(r), F.lit(planted)) for k, r in enumerate(("user", "assistant"))])
    said = said.union(spark.range(1).select(F.inline(extra)))
    # Each row is one message of the log: a turn of its own, said in one piece.
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    events = said.withColumn("turn", number).withColumns({"seq": F.col("turn"), "kind": F.lit("delta")})
    shown = chat_log.render(chat_log.fold(events))
    loss = chat_log.read_loss(F.col("formatted"), F.col("mask"))
    turns = F.transform(chat_log.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = shown.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op10_license_scan", oracles.LICENCES)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The table has no paths: sources are the top folders, languages below them, a hundred folders below
    # those. A short text that opens with a licence line is the licence file of its language's folder.
    top = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    opens = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).rlike(license_scan.CUE) & (F.char_length("text") < 400)
    path = F.when(opens, F.concat(top, F.lit("/LICENSE."), F.col("doc_id"))).otherwise(F.concat_ws("/", top, F.pmod("doc_id", F.lit(100)), F.concat("doc_id", F.lit(".txt"))))
    return license_scan.scan(docs.withColumn("path", path), key="doc_id")


@query("op13_prefix_trie", oracles.TRIE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query("op12_disclosure", oracles.PRIVATE)
def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = disclosure.spans_of(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    words = F.transform("words", lambda w: F.struct(w["start"], F.lit(len(disclosure.KINDS)).alias("rank"), F.lit("term").alias("kind"), w["end"]))
    return marked.select(
        "doc_id",
        *[count(k) for k in disclosure.KINDS],
        F.sha2(said(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        said(F.array_sort(F.concat("spans", words))).alias("spans"),
        F.size("words").cast("long").alias("n_terms"),
    )


@query("op11_collocations", oracles.PHRASES)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = collocations.top(collocations.mine(table(spark, sf_dir, "documents")), first=2000)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")
