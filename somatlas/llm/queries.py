"""The subpackage's queries: (spark, sf_dir) -> DataFrame, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somatlas.llm import chat, decontam, langid, ogg, oracles, packing, revisit, sharding, simhash, toxicity, zframes
from somatlas.runtime import Scratch, ship_package, table

TOKENIZER = "word_bpe_49k.json"
SAYING = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), Scratch(spark, "op1"), 16)


def op2_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SAYING).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    nodes, turns = chat.chain_nodes(rows, scratch)
    # Every conversation gets another, lower branch, so that what comes out is what the ranking chose.
    replies, texts = chat.rejected_replies(nodes, "a reply that was not chosen")
    chats = chat.format_paths(chat.reply_paths(nodes.unionByName(replies), scratch), turns.unionByName(texts))
    return chat.read_back(chats).select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures made of the pages, up to seven of each; digests are of the pages' html.

    Under the page's own URL: a response (visit 0); a revisit with the same
    ETag (1); one with an ETag of another version, or without any (2); and for
    every fifth page a revisit before any response (3). Under a URL that four
    pages share, written in two ways: a response (4), of even pages with an
    ETag and of odd ones with Last-Modified; a revisit with the same validator
    (5) and one without any (6), both after the next page's response, so that
    its version decides and not the page's own. Header names are in any case.
    """
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    h = lambda *kv: F.create_map(*map(lambda x: F.lit(x) if isinstance(x, str) else x, kv))
    n, digest = F.col("page_id"), F.col("digest")
    day, even, group = F.lpad((n % 28 + 1).cast("string"), 2, "0"), n % 2 == 0, F.expr("page_id div 4").cast("string")
    shared = F.when(even, F.concat(F.lit("https://www.Archive.example/v/~"), group)).otherwise(F.concat(F.lit("HTTP://archive.example:80/old/../v/./%7e"), group, F.lit("/?utm_source=feed#top")))
    visit = lambda k, url, at, kind, headers: F.struct(F.lit(k).alias("visit"), url.alias("url"), at.cast("long").alias("at"), F.lit(kind).alias("kind"), headers.alias("headers"))
    visits = F.array(
        visit(0, F.col("url"), n * 10, "response", h("ETag", digest, "Content-Type", "text/html", "cache-control", "max-age=60")),
        visit(1, F.col("url"), n * 10 + 1, "revisit", h("etag", F.concat(F.lit("W/"), digest), "Content-Type", "text/plain", "DATE", day)),
        visit(2, F.col("url"), n * 10 + 2, "revisit", F.when(n % 3 == 0, h("Etag", "other")).otherwise(h("Expires", day))),
        visit(3, F.col("url"), F.when(n % 5 == 0, F.lit(-1)), "revisit", h("Date", day)),
        visit(4, shared, n * 10 + 3, "response", F.when(even, h("ETag", digest, "Vary", "accept")).otherwise(h("Last-Modified", day, "Server", "s"))),
        visit(5, shared, n * 10 + 15, "revisit", F.when(even, h("ETAG", digest, "Last-Modified", day)).otherwise(h("last-modified", day, "Content-Location", "/c"))),
        visit(6, shared, n * 10 + 16, "revisit", h("Vary", "*", "Server", "t")),
    )
    c = p.withColumn("v", F.explode(visits)).where("v.at is not null")
    return c.select((n * 8 + F.col("v.visit")).alias("capture_id"), "v.url", "v.at", "v.kind", "v.headers", "digest")


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve_revisits(page_captures(spark, sf_dir), Scratch(spark, "op4"))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.withColumn("headers", F.array_join(entries, ";"))


def op5_ogg_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ogg.to_ogg(table(spark, sf_dir, "documents"), with_media=False)


def op6_zstd_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return zframes.read_files(zframes.encode_corpus(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), tokenizer_path()))


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pack_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "op8"), tokenizer_path())


def op9_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return langid.predict_documents(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op10"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_rendezvous_shards, op2_chat_reply_trees, op3_toxicity_neighbours, op4_warc_revisits, op5_ogg_pages, op6_zstd_seekable, op7_simhash_components, op8_pack_cutting_stock, op9_language_ftrl, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
