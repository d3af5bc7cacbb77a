"""Block, digest and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.operators import blocks as B
from blockloom.plans.catalog import query, table

_BLOCKS = """SELECT doc_id, i AS block_no, substr(hex(encode(text)), i * 1024 + 1, 1024) AS h
FROM (SELECT doc_id, text, unnest(generate_series(0, (strlen(text) - 1) // 512)) AS i FROM documents WHERE strlen(text) > 0)"""


def _blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    return B.split_blocks(docs, "payload", 512)


@query(f"SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, CAST(length(h) // 2 AS INTEGER) AS n_bytes, substr(h, 1, 16) AS head FROM ({_BLOCKS})")
def q_block_split(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "block_no", F.octet_length("block").alias("n_bytes"), F.hex(F.substring("block", 1, 8)).alias("head"))


@query(f"SELECT doc_id, CAST(block_no AS INTEGER) AS block_no, sha1(from_hex(h)) AS sha1 FROM ({_BLOCKS})")
def q_block_sha1(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "block_no", F.sha1("block").alias("sha1"))


@query(f"""WITH b AS (SELECT doc_id, block_no, sha1(from_hex(h)) AS d FROM ({_BLOCKS})),
subs AS (SELECT doc_id, block_no // 204 AS sub_no, sha1(from_hex(rpad(string_agg(d, '' ORDER BY block_no), 8192, '0'))) AS sub, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, sha1(from_hex(rpad(string_agg(sub, '' ORDER BY sub_no), 8192, '0'))) AS master, CAST(sum(n) AS BIGINT) AS n_blocks FROM subs GROUP BY doc_id""")
def q_hash_rollup(spark, sf_dir):
    return B.hash_rollup(q_block_sha1(spark, sf_dir), ["doc_id"])


@query("SELECT conv_id, list_reduce(list_prepend('', list(text ORDER BY turn DESC)), lambda a, x: sha1(x || a)) AS first_digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def q_back_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(B.chain_digest(F.col("text"), F.col("turn")).alias("first_digest"), F.count(F.lit(1)).alias("turns"))


@query("""WITH c AS (SELECT conv_id, hex(encode(string_agg(text, '' ORDER BY turn))) AS h FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(i AS INTEGER) AS chunk_no, sha1(from_hex(substr(h, i * 512 + 1, 512))) AS sha1
FROM (SELECT conv_id, h, unnest(generate_series(0, (length(h) // 2 - 1) // 256)) AS i FROM c WHERE length(h) > 0)""")
def q_concat_chunk(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("text"))
    return B.rechunk(c, ["conv_id"], "turn", "text", 256).select("conv_id", F.col("chunk_no").cast("int").alias("chunk_no"), F.sha1("block").alias("sha1"))


@query("""SELECT doc_id, CAST((n + 511) // 512 AS BIGINT) AS blocks_512, CAST((n + 4095) // 4096 AS BIGINT) AS blocks_4096,
CAST(n + (1024 - n % 1024) % 1024 AS BIGINT) AS padded_1024, CAST((4 - n % 4) % 4 AS BIGINT) AS pad_4 FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def q_align(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    d = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
    c = F.col("n")
    return d.select("doc_id", B.ceil_div(c, 512).alias("blocks_512"), B.ceil_div(c, 4096).alias("blocks_4096"), B.align_up(c, 1024).alias("padded_1024"), (B.align_up(c, 4) - c).alias("pad_4"))


@query("""SELECT doc_id, upper(substr(hex(encode(text)), 1, 16)) AS head, upper(substr(hex(encode(text)), 17, 8)) AS field, strlen(text) >= 12 AS whole
FROM documents WHERE strlen(text) > 0""")
def q_header_slice(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("p")).where(F.octet_length("p") > 0)
    return d.select("doc_id", F.hex(F.substring("p", 1, 8)).alias("head"), F.hex(F.substring("p", 9, 4)).alias("field"), (F.octet_length("p") >= 12).alias("whole"))
