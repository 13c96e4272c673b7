"""The operators over whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontamination, embeddings, importance, langid, line_dedup, mixing, ngram_join, periodic_runs, pii, sharding, substring_dedup, toxicity
from .common import table


def op1_chat_prefix_tree(spark, sf_dir):
    return chat.digest(table(spark, sf_dir, "conversations"))


def op2_benchmark_decontamination(spark, sf_dir):
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark, sf_dir):
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark, sf_dir):
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_balanced_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return langid.digest(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    every = [op1_chat_prefix_tree, op2_benchmark_decontamination, op3_toxicity, op4_pii, op5_balanced_sharding, op6_embedding_near_dedup, op7_source_mixing, op8_ngram_jaccard_join, op9_substring_dedup, op10_language_id, op11_periodic_runs, op12_importance_resampling, op13_line_dedup, pipeline]
    return {f.__name__: f for f in every}


_SAID = r"\### Assistant: </turn> ok"
_ESCAPES = "(len({0}) - len(replace({0}, '\\', ''))) + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: len(x) - 2)), 0) + (len({0}) - len(replace({0}, '</turn>', ''))) // 7"
_CHATS = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + len(role) + {_ESCAPES.format("role")} + (len(role) - len(replace(role, ': ', ''))) // 2 + len(text) + {_ESCAPES.format("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY 1"""
_REACH = "reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)"
_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93), {_REACH},
n AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1), r AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(r.b, vec_id)) AS component_id, vec_id <= coalesce(r.b, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN r ON r.a = vec_id"""
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NGRAMS = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)), {_REACH},
r AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.b, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.a = d.doc_id"""
_REPEATS = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20))),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM win WHERE k > 1),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
left_ AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (doc_id) LEFT JOIN n USING (doc_id)"""

_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE len(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT k.*, coalesce(r.first <> k.doc_id, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY 1"""


def oracle_sql():
    """Operators that SQL expresses over whole tables in reasonable time; the others are tested against brute force or by
    held-out labels."""
    return {"op1_chat_prefix_tree": _CHATS, "op6_embedding_near_dedup": _VECTORS, "op8_ngram_jaccard_join": _NGRAMS, "op9_substring_dedup": _REPEATS, "op13_line_dedup": _LINES}
