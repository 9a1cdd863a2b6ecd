"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.views import u_sql

from .bpe import bpe_round_trip
from .common import table
from .contamination import find_contamination
from .divergence import source_divergence
from .line_dedup import line_dedup
from .merkle import audit
from .mixing import mix_sources
from .quality_rules import quality_rules
from .near_dedup import near_duplicates
from .quality_fm import quality_scores
from .records import token_records
from .repeats import drop_repeats
from .suffix_tree_lm import suffix_tree_scores
from .toxicity import toxicity_scores


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file: under $TOKENIZER_DIR, else in the installed package of such files."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, held=2, threshold=0.3)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80).drop("text_hash")


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"), folds=7, held=2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, least=0.8)


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held=1, threshold=0.5)


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), length=200).drop("kept")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), percent=150, repeats=2)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), min_docs=30, smooth=5, top=50)


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_suffix_tree_lm": op4_suffix_tree_lm,
    "op5_decontamination": op5_decontamination,
    "op6_quality_fm": op6_quality_fm,
    "op7_repeated_bytes": op7_repeated_bytes,
    "op8_token_records": op8_token_records,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_mix": op12_source_mix,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key) GROUP BY doc_id""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, n_chars, cast(doc_id AS varchar) AS d, source AS s, lang AS l, text AS t,
    -- the bits of crc32 of the decimal doc_id, byte by byte; -1 stands for a shift
    xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::bigint) ELSE a >> 1 END), 4294967295::bigint) AS crc
  FROM documents
), fields AS (
  SELECT doc_id, tree, coalesce(strlen(d) || ':' || d, '-') || coalesce(strlen(s) || ':' || s, '-') || coalesce(strlen(l) || ':' || l, '-') AS head,
    cast(n_chars AS varchar) AS n, cast(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS varchar) AS m, coalesce(strlen(t) || ':' || t, '-') AS tail FROM rows
), leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(n) || ':' || n, '-') || tail) AS leaf, sha256(head || coalesce(strlen(m) || ':' || m, '-') || tail) AS claim FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT tree, 0 AS k, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT a.tree, a.k + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0 AND a.n > 1
), trees AS (
  SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS k, pos, n, subroot AS h FROM trees
  UNION ALL
  SELECT a.k + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) FROM upper a LEFT JOIN upper b ON b.pos = a.pos + 1 WHERE a.pos % 2 = 0 AND a.n > 1
), steps AS (
  SELECT p.tree, p.pos, 0 AS part, v.k, CASE WHEN (p.pos >> v.k) % 2 = 1 THEN '<' ELSE '>' END || coalesce(s.h, '') AS step
  FROM placed p JOIN (SELECT DISTINCT tree, k FROM nodes WHERE n > 1) v ON p.tree = v.tree LEFT JOIN nodes s ON s.tree = p.tree AND s.k = v.k AND s.pos = xor(p.pos >> v.k, 1)
  UNION ALL
  SELECT p.tree, p.pos, 1, v.k, CASE WHEN (t.pos >> v.k) % 2 = 1 THEN '<' ELSE '>' END || coalesce(s.h, '')
  FROM placed p JOIN trees t ON p.tree = t.tree CROSS JOIN (SELECT DISTINCT k FROM upper WHERE n > 1) v LEFT JOIN upper s ON s.k = v.k AND s.pos = xor(t.pos >> v.k, 1)
), paths AS (SELECT tree, pos, list(step ORDER BY part, k) AS path FROM steps GROUP BY tree, pos
), folded AS (
  SELECT p.doc_id, p.leaf, t.subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(array_to_string(list_transform(coalesce(path, []), lambda x: x[2:]), '')) AS proof_sha256,
    list_reduce(list_concat([p.claim], coalesce(path, [])), lambda a, x: CASE WHEN x[1] = '<' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root
  FROM placed p JOIN trees t ON p.tree = t.tree LEFT JOIN paths q ON q.tree = p.tree AND q.pos = p.pos
)
SELECT *, folded_root = root AS verified FROM folded""",
    "op12_source_mix": rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, {u_sql(42, "coalesce(cast(doc_id AS varchar), '')")} AS u FROM documents
), sources AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][1 + (rank - 1) % 3] AS weight FROM sources
), summed AS (
  SELECT *, source_size / weight AS full_at, sum(source_size) OVER () * 150 - (sum(source_size) OVER o - source_size) * 200 AS rest_words, sum(weight) OVER () - sum(weight) OVER o + weight AS rest
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, rank ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT rest_words, rest FROM summed WHERE source_size * 200 * rest > rest_words * weight ORDER BY full_at, rank LIMIT 1
), shared AS (
  SELECT source, source_size, rank, coalesce(least((source_size * 2)::double, (SELECT weight * rest_words::double / (rest * 100.0::double) FROM level)), (source_size * 2)::double) AS target FROM weighed
), queues AS (
  SELECT z.doc_id, z.source, z.size, s.source_size, s.rank, s.target, sum(z.size) OVER (PARTITION BY z.source ORDER BY u, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS upto FROM sizes z JOIN shared s ON z.source IS NOT DISTINCT FROM s.source
), mix AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, copy, upto ROWS UNBOUNDED PRECEDING) AS reached FROM (SELECT *, (copy * source_size + upto)::double / target AS finish FROM queues, (VALUES (0), (1)) AS c(copy) WHERE target > 0)
), ends AS (
  SELECT doc_id, source, size, source_size, target, 0 AS taken FROM queues
  UNION ALL
  SELECT doc_id, source, size, source_size, target, size FROM mix WHERE reached <= (SELECT sum(size) * 150 // 100 FROM sizes)
)
SELECT doc_id, source, size, source_size, target, sum(taken)::bigint AS taken FROM ends GROUP BY ALL""",
    "op13_source_divergence": r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), tokens AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), kept AS (
  SELECT lang, term, count(*) AS in_lang FROM tokens GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(in_lang)::hugeint AS lang_n FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::hugeint AS group_n
  FROM (SELECT DISTINCT lang, source FROM texts) g LEFT JOIN langs USING (lang)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (group_n + 5 * v) AS p, 1 + (1000000000::hugeint * (in_lang + 5)) // (lang_n + 5 * v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), distances AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
