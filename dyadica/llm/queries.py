"""Registered training-data queries, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import broken_pairs, consensus, encoding, grouped_splits, leakage, personal_info
from . import shared_spans, similarity_clusters, term_frequency, truncation


def _p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "assumptions")
    counts = term_frequency.term_counts(rows, "cell_key", {"assumption": "value", "description": "words"})
    return term_frequency.marked_terms(counts)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and words too rare or too common to serve as topic words."""
    return _p1_counts(spark, sf_dir).filter("mark is not null").select("field", "term", "mark")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and cells of every label and word."""
    return _p1_counts(spark, sf_dir).select("field", "term", "occurrences", "records")


P1_TERMS = r"""
WITH terms AS (
  SELECT 'assumption' AS field, cell_key,
         regexp_replace(trim(regexp_replace(lower(assumption), '[^a-z0-9]+', ' ', 'g')), '^the user is ', '') AS term
  FROM assumptions WHERE assumption IS NOT NULL
  UNION ALL
  SELECT 'description', cell_key, unnest(regexp_extract_all(lower(description), '[a-z0-9]+'))
  FROM assumptions WHERE description IS NOT NULL),
kept AS (SELECT * FROM terms WHERE term <> ''),
totals AS (SELECT field, count(DISTINCT cell_key) AS total FROM kept GROUP BY field),
counts AS (SELECT field, term, CAST(count(*) AS BIGINT) AS occurrences,
                  CAST(count(DISTINCT cell_key) AS BIGINT) AS records
           FROM kept GROUP BY field, term)
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of responses that say much the same."""
    return similarity_clusters.cluster_members(table(spark, sf_dir, "response_vectors"), "vec_id", "vector")


def p2_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and most typical responses."""
    return similarity_clusters.cluster_profiles(table(spark, sf_dir, "response_vectors"), "vec_id", "vector")


def _p3(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return consensus.consensus(table(spark, sf_dir, "teacher_labels"), ["cell_key", "dimension"], "teacher_id", "score", "labelled_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level of each cell and dimension."""
    return _p3(spark, sf_dir)[0].select("cell_key", "dimension", "level")


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the level's probability and the share of votes for it."""
    return _p3(spark, sf_dir)[0]


def p3_teachers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each teacher."""
    return _p3(spark, sf_dir)[1]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text and each kind of personal information in it."""
    return personal_info.kinds_found(table(spark, sf_dir, "personas"), table(spark, sf_dir, "prompts"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with typed placeholders."""
    texts = personal_info.message_texts(table(spark, sf_dir, "personas"), table(spark, sf_dir, "prompts"))
    return personal_info.scan_texts(texts, personal_info.TEXT_KEYS, "text").select(*personal_info.TEXT_KEYS, F.col("redacted").alias("text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each cell."""
    return grouped_splits.linked_groups(table(spark, sf_dir, "attempt_log"), "cell_key", "persona_id", "prompt_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of each cell, framings balanced too."""
    log = table(spark, sf_dir, "attempt_log")
    framing = log.groupBy("cell_key").agg(F.max((F.col("prompt_type") == "original_post").cast("double")).alias("value"))
    return grouped_splits.assign_splits(p5_found(spark, sf_dir), "cell_key", framing)


def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: all cells, whether its own are within two per cent of its share, and the
    groups that stand in more than one split."""
    placed = p5_splits(spark, sf_dir)
    total = placed.agg(F.count("*").alias("total"))
    torn = placed.filter("group_key is not null").groupBy("group_key").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("torn"))
    share = F.create_map(*[F.lit(x) for kv in grouped_splits.SPLITS.items() for x in kv])
    sizes = placed.groupBy("split").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(torn))
    off = F.abs(F.col("n") - F.element_at(share, F.col("split")) * F.col("total"))
    return sizes.select("split", "total", (off <= 0.02 * F.col("total")).alias("close"), "torn")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective replies with their defect."""
    replies, prompts = table(spark, sf_dir, "parsed_probes"), table(spark, sf_dir, "prompts")
    limits = table(spark, sf_dir, "model_specs").select("alias", "max_output_tokens")
    return broken_pairs.broken_pairs(replies, prompts, "response_id", "response", "alias", "prompt_id", "prompt_type", "text", limits)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that break off."""
    limits = table(spark, sf_dir, "model_specs").select("alias", "max_output_tokens")
    return truncation.cut_values(table(spark, sf_dir, "parsed_probes"), "response_id", "alias", "response", limits).select("response_id", "alias")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each model's replies break off, with its limit."""
    replies = table(spark, sf_dir, "parsed_probes")
    shares = truncation.cut_shares(replies, p7_found(spark, sf_dir), "response_id", "alias")
    specs = table(spark, sf_dir, "model_specs").select("alias", "max_output_tokens")
    return shares.join(specs, "alias", "left")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encoding.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text again, from its ids."""
    return encoding.decode_corpus(p8_ids(spark, sf_dir), "doc_id")


def _p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leakage.leaked_passages(docs, items, "doc_id", "text", "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items they leak."""
    return leakage.leaks(_p9_passages(spark, sf_dir), "doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item, in how many documents it leaks and the longest leak in words."""
    return _p9_passages(spark, sf_dir).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest")
    )


def p9_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaking document, how much leaks and whether the record or its passages should go."""
    return leakage.leak_removal(table(spark, sf_dir, "documents"), _p9_passages(spark, sf_dir), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a long passage with another one."""
    return shared_spans.shared_records(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared passages, as maximal intervals of characters."""
    return shared_spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, the share of its text that stands elsewhere."""
    return shared_spans.shared_share(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_profiles": p2_profiles,
    "p3_found": p3_found,
    "p3_agreement": p3_agreement,
    "p3_teachers": p3_teachers,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p5_balance": p5_balance,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_shares": p7_shares,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p9_removal": p9_removal,
    "p10_found": p10_found,
    "p10_spans": p10_spans,
    "p10_share": p10_share,
}

CLEAN = "nullif(nullif(lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), ''), 'none')"
GRAMS = """{0}w AS (SELECT DISTINCT {1}, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {2} WHERE text IS NOT NULL),
{0}g AS (SELECT DISTINCT {1}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {1}, w, unnest(range(1, len(w) - 10)) AS i FROM {0}w))"""
#: Each word of a document at which twelve words in a row start that some item holds too.
LEAKS = "WITH " + GRAMS.format("d", "doc_id", "documents") + ", " + GRAMS.format("i", "item_id", "eval_items") + """,
dp AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
hit AS (SELECT DISTINCT doc_id, item_id, i FROM dp JOIN ig USING (g)),
runs AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY i) AS r FROM hit) GROUP BY doc_id, item_id, r)"""
#: The starts of all windows of 400 characters that stand in another document too, in islands.
SPANS = """WITH w AS (SELECT doc_id, i - 1 AS st, md5(substring(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), hit AS (SELECT DISTINCT doc_id, st FROM w WHERE h IN (SELECT h FROM s)),
fresh AS (SELECT *, CASE WHEN st > coalesce(lag(st) OVER (PARTITION BY doc_id ORDER BY st), -401) + 400 THEN 1 ELSE 0 END AS f FROM hit),
island AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY st) AS k FROM fresh),
span AS (SELECT doc_id, min(st) AS "start", max(st) + 400 AS "end", max(st) + 400 - min(st) AS n_chars FROM island GROUP BY doc_id, k)"""

ORACLES = {
    "p1_found": P1_TERMS
    + """SELECT field, term, CASE WHEN records < 3 THEN 'rare' ELSE 'common' END AS mark
         FROM counts JOIN totals USING (field) WHERE records < 3 OR records > total * 0.1""",
    # Reachability and all pairs: exact, for tables as small as the oracle's.
    "p2_found": """
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, vector FROM response_vectors WHERE vector IS NOT NULL AND len(vector) > 0
  AND NOT list_bool_or(list_transform(vector, lambda x: isnan(x))) AND list_sum(list_transform(vector, lambda x: x * x)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.vector) = len(b.vector) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.vector, b.vector) >= 0.75),
r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS vec_id, min(b) AS cluster_id FROM r GROUP BY a""",
    "p5_found": f"""
WITH RECURSIVE c AS (SELECT DISTINCT cell_key, {CLEAN.format('persona_id')} AS p, {CLEAN.format('prompt_id')} AS q FROM attempt_log WHERE cell_key IS NOT NULL),
e AS (SELECT DISTINCT x.q AS a, y.q AS b FROM c x JOIN c y ON x.p = y.p OR x.cell_key = y.cell_key WHERE x.q <> y.q),
r(a, b) AS (SELECT DISTINCT q, q FROM c WHERE q IS NOT NULL UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
g AS (SELECT a, min(b) AS m FROM r GROUP BY a), o AS (SELECT p, min(q) AS q FROM c WHERE p IS NOT NULL GROUP BY p)
SELECT cell_key, min(m) AS group_key FROM (SELECT cell_key, coalesce(c.q, o.q) AS a FROM c LEFT JOIN o ON o.p = c.p) LEFT JOIN g USING (a) GROUP BY cell_key""",
    "p9_found": "WITH " + GRAMS.format("d", "doc_id", "documents") + ", " + GRAMS.format("i", "item_id", "eval_items") + " SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p10_found": """
WITH w AS (SELECT doc_id, md5(substring(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)) SELECT DISTINCT doc_id FROM w WHERE h IN (SELECT h FROM s)""",
    "p5_balance": """SELECT split, (SELECT count(DISTINCT cell_key) FROM attempt_log) AS total, true AS close, CAST(0 AS BIGINT) AS torn FROM (VALUES ('train'), ('validation'), ('test')) v(split)""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_items": LEAKS + " SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n) AS longest FROM runs GROUP BY item_id",
    "p9_removal": LEAKS + """, cov AS (SELECT doc_id, count(*) AS leaked_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 12)) AS p FROM hit) GROUP BY doc_id),
sz AS (SELECT doc_id, max(len(w)) AS n_words FROM dw GROUP BY doc_id), lo AS (SELECT doc_id, max(n) AS longest FROM runs GROUP BY doc_id)
SELECT doc_id, longest, leaked_words, n_words, CASE WHEN longest > 50 OR leaked_words > 0.2 * n_words THEN 'drop' ELSE 'cut' END AS action FROM lo JOIN cov USING (doc_id) JOIN sz USING (doc_id)""",
    "p10_spans": SPANS + """ SELECT doc_id, "start", "end", n_chars FROM span""",
    "p10_share": SPANS + """, own AS (SELECT doc_id, max(length(coalesce(text, ''))) AS n_chars FROM documents GROUP BY doc_id), sh AS (SELECT doc_id, sum(n_chars) AS s FROM span GROUP BY doc_id)
SELECT doc_id, CAST(least(coalesce(s, 0), own.n_chars) AS BIGINT) AS shared_chars, own.n_chars, least(coalesce(s, 0), own.n_chars) / nullif(own.n_chars, 0) AS share FROM own LEFT JOIN sh USING (doc_id)""",
    "p1_counts": P1_TERMS + "SELECT field, term, occurrences, records FROM counts",
}
