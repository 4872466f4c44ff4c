"""The llm queries and, where SQL expresses them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .chat import conversation_digests, format_turns, text_part
from .decontaminate import contamination
from .htmltext import extract_pages
from .licenses import license_report
from .minhash import near_duplicates
from .mixing import mixture
from .quality import quality_scores
from .tables import table
from .tokencount import token_counts
from .toxicity import toxicity_scores
from .vectors import near_vectors

#: A-Z lowered, as SQL.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def op1_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licenses(spark, sf_dir):
    return license_report(table(spark, sf_dir, "documents"))


def op3_tokens(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_mixing(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"))


def op5_html(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_turns(rows.unionByName(added).withColumn("parts", text_part(F.col("text")))))


def op8_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_licenses": op2_licenses,
    "op3_tokens": op3_tokens,
    "op4_mixing": op4_mixing,
    "op5_html": op5_html,
    "op6_minhash": op6_minhash,
    "op7_chat": op7_chat,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_vectors": op10_vectors,
}

SQL = {
    "op6_minhash": f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, {_SPACED}) w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) sh FROM t),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id u, b.doc_id v, count(*) i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u src, u dst FROM e UNION SELECT r.src, e.v FROM r JOIN e ON r.dst = e.u),
c AS (SELECT src, min(dst) c FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, coalesce(c.c, t.doc_id) component_id, t.doc_id = coalesce(c.c, t.doc_id) kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.src = t.doc_id""",
    "op7_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '<|turn|>' || replace(replace(replace(role, '\', '\\'), '|', '\|'), chr(10), '\n') || chr(10) || replace(replace(t, '\', '\\'), '|', '\|') || '<|end|>' || chr(10) shown FROM c)
SELECT conv_id::BIGINT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, shown)) turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, shown) FILTER (role = 'assistant'), '')) loss_sha256, sum(length(shown))::BIGINT formatted_chars
FROM f GROUP BY 1""",
    "op8_decontaminate": f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) END) win, least(10, len(w)) size FROM b),
sizes AS (SELECT DISTINCT size FROM win),
t AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOW}, {_ALNUM}) w FROM documents),
d AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) p FROM t, sizes WHERE len(w) >= size),
m AS MATERIALIZED (SELECT doc_id, p, size, item_id FROM (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') win FROM d) JOIN win USING (win, size)),
h AS (SELECT doc_id, count(*) n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op10_vectors": """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id u, b.vec_id v FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT u src, v dst FROM l UNION SELECT r.src, l.v FROM r JOIN l ON r.dst = l.u),
c AS (SELECT src, min(dst) c FROM r GROUP BY 1), n AS (SELECT u, count(*) n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n, 0)::BIGINT n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) component_id, e.vec_id = least(e.vec_id, coalesce(c.c, e.vec_id)) kept
FROM embeddings e LEFT JOIN c ON c.src = e.vec_id LEFT JOIN n ON n.u = e.vec_id""",
}
