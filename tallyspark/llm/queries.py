"""One registered query for each operator, over its whole table with the parameters used in production."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import conversations, decontam, embeddings, idpack, lines, lm, minhash, packing, repeats, search, sharding, toxicity, wordpiece
from .common import table
from .registry import query


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_benchmark_decontamination")
def _(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_packing")
def _(spark, sf_dir):
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


@query("op3_minhash_near_dedup")
def _(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op4_token_files")
def _(spark, sf_dir):
    return idpack.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=2).drop("uri")


@query("op5_token_counts")
def _(spark, sf_dir):
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op6_toxicity")
def _(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_embedding_near_dedup")
def _(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op8_lm_scoring")
def _(spark, sf_dir):
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query("op9_sharding")
def _(spark, sf_dir):
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    law, none = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", none)


@query("op10_line_dedup")
def _(spark, sf_dir):
    cut = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return cut.select("doc_id", F.size("removed").alias("n_removed"), "removed", F.crc32(text).alias("text_crc32"), "text")


@query("op11_conversation_repair")
def _(spark, sf_dir):
    given = table(spark, sf_dir, "conversations")
    found = conversations.report(conversations.repair(conversations.damaged(given))).alias("f")
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("e")
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    joined = every.join(found, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    audit, hashed = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256")
    return joined.select("e.conv_id", *counts, audit, hashed)


TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op13_ranked_search", f"""
WITH item AS (
    SELECT item_id, unnest(list_distinct({TERMS})) AS term
    FROM benchmark
), held AS (
    SELECT row, doc_id, unnest({TERMS}) AS term
    FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), length AS (
    SELECT row, doc_id, count(*) AS n FROM held GROUP BY row, doc_id
), total AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM length
), normal AS (
    SELECT row, doc_id, 50 + (50 * n * docs) // words AS m FROM length, total
), posting AS (
    SELECT row, term, count(*) AS tf FROM held SEMI JOIN item USING (term) GROUP BY row, term
), weight AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), total
), scored AS (
    SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM item JOIN posting USING (term) JOIN weight USING (term) JOIN normal USING (row)
    GROUP BY item_id, row, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""")
def _(spark, sf_dir):
    index, n = search.build_index(table(spark, sf_dir, "documents"))
    return search.search(index, n, table(spark, sf_dir, "benchmark"), k=50)


@query("op12_suffix_dedup")
def _(spark, sf_dir):
    cut = repeats.cut_repeats(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    n_spans = F.size("removed").cast("long").alias("n_spans")
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), n_spans, F.sha2("kept", 256).alias("kept_sha256"))
