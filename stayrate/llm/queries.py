"""Registered queries of the training-data operators, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.llm import (bpe, decontaminate, embeddings, licenses, mixing, periods, phrases, quality,
                          sharding, simhash, substrings, tokens, toxicity)

MIX = {"weights": [3, 1, 2], "budget_share": 1.5, "max_epochs": 2, "seed": 42}
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_50k.json"), 512)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.7)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), **MIX)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"), licenses.registry(spark))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_table(table(spark, sf_dir, "documents"),
                                   table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(table(spark, sf_dir, "documents"), SHARDS)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_table(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_simhash, op2_substrings, op3_embeddings, op4_tokens, op5_quality, op6_toxicity, op7_mixing,
    op8_licenses, op9_decontaminate, op10_sharding, op11_bpe, op12_phrases, op13_periods)}

OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
      AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(node, low) AS (SELECT a, b FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.low),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links,
       least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.node = e.vec_id
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) * 2 AS DOUBLE) AS cap,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight
  FROM d GROUP BY source),
o AS (
  SELECT cap / weight AS ratio, sum(cap) OVER low AS held, sum(weight) OVER low AS held_weight,
         lead(cap / weight) OVER (ORDER BY cap / weight) AS next_ratio
  FROM s WINDOW low AS (ORDER BY cap / weight RANGE UNBOUNDED PRECEDING)),
t AS (SELECT sum(source_size) * 1.5::DOUBLE AS budget, sum(weight) AS weight, min(cap / weight) AS low
      FROM s),
level AS (
  SELECT CASE WHEN budget / weight < low THEN budget / weight
         ELSE (SELECT min((budget - held) / (t.weight - held_weight)) FROM o
               WHERE held_weight < t.weight AND next_ratio > ratio
                 AND (budget - held) / (t.weight - held_weight) >= ratio
                 AND (budget - held) / (t.weight - held_weight) < next_ratio) END AS l FROM t),
p AS (SELECT source, source_size, least(cap, l * weight) AS target,
             CASE WHEN source_size > 0 THEN
               CAST(floor(least(cap, l * weight) / source_size) AS BIGINT) ELSE 0 END AS base
      FROM s, level),
q AS (SELECT *, greatest(0, CAST(round(target) AS BIGINT) - base * source_size) AS extra FROM p),
k AS (
  SELECT d.*, q.source_size, q.target, q.base, q.extra,
         CAST(sum(d.size) OVER upto AS BIGINT) AS upto,
         CAST(sum(d.size) OVER (PARTITION BY d.source, d.key) AS BIGINT) AS tie
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
  WINDOW upto AS (PARTITION BY d.source ORDER BY d.key RANGE UNBOUNDED PRECEDING))
SELECT doc_id, size, source_size, target,
       CAST(base * size + CASE WHEN size = 0 OR extra = 0 OR upto - tie >= extra THEN 0
              WHEN upto <= extra THEN size
              ELSE floor(size * (CAST(extra - upto + tie AS DOUBLE) / tie)) END AS BIGINT) AS taken
FROM k
"""

OP9 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
    FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, i, dw.n, item FROM dw JOIN bw USING (g, n)),
p AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h)
      GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
      FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""

OP12 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
      SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
      FROM w, (VALUES (1), (2), (3), (4)) AS k(m) WHERE len(w) >= m))
  GROUP BY lang, m, phrase HAVING count(*) >= 30),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k, l.f AS l, r.f AS r,
         CAST((2000000::HUGEINT * a) // (l.f + r.f) AS BIGINT) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:k], ' ')
         JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT *, unnest(range(1, m - n + 2)) AS i FROM c, (VALUES (2), (3)) AS q(n) WHERE n < m)
  GROUP BY ALL),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(column: str) -> str:
    """SQL for the words of a text in lower case, one spelling each, between single blanks."""
    form = (f"'  ' || regexp_replace(replace(lower({column}), '©', ' c '), "
            "'[^\\p{L}\\p{N}]+', '  ', 'g') || '  '")
    for variant, standard in licenses.EQUIVALENT:
        form = f"replace({form}, ' {variant} ', ' {standard} ')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


def _without_notice(rows: str, form: str, keep: str) -> str:
    """SQL that adds to ``rows`` the column ``clean``: the list of words is searched for the
    first notice within 13 words, and from there on for the nearest opening of a known text
    within 100 words; what lies between is cut out."""
    return f"""
  SELECT {keep}, CASE WHEN start IS NULL OR stop IS NULL THEN {form}
         ELSE trim(array_to_string(w[1:start - 1], ' ') || ' ' || array_to_string(w[stop:], ' ')) END AS clean
  FROM (
    SELECT *, list_filter(range(start + 1, least(start + 102, len(w) + 1)), lambda i:
        len(list_filter(o, lambda x: starts_with(array_to_string(w[i:i + 7], ' ') || ' ', x || ' '))) > 0)[1] AS stop
    FROM (
      SELECT *, list_filter(range(1, least(14, len(w) + 1)), lambda i:
          (w[i] = 'copyright' AND w[i + 1] IS NOT NULL AND NOT regexp_full_match(w[i + 1],
             '(notice|holder|owner|law|license|statement)s?'))
          OR (w[i] = 'c' AND regexp_full_match(coalesce(w[i + 1], ''), '(19|20)[0-9][0-9]')))[1] AS start
      FROM (SELECT *, string_split({form}, ' ') AS w FROM {rows}, (SELECT list(o) AS o FROM opens))))"""


OP8 = f"""
WITH texts AS (
  SELECT id, {_words('t')} AS form FROM (VALUES
    {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in licenses.KNOWN)}) AS k(id, t)),
opens AS (
  SELECT DISTINCT array_to_string(string_split(form, ' ')[1:8], ' ') AS o FROM texts
  WHERE NOT regexp_matches(form, '^(copyright|c) ')),
bare AS ({_without_notice('texts', 'form', 'id')}),
known AS (SELECT sha256(clean) AS digest, min(id) AS license_id FROM bare GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
u AS (
  SELECT rid, text AS unit, TRUE AS is_whole FROM d WHERE text IS NOT NULL
  UNION ALL SELECT rid, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')), FALSE FROM d
  UNION ALL SELECT rid, unnest(string_split(text, chr(10))), FALSE FROM d),
f AS (SELECT rid, is_whole, {_words('unit')} AS form FROM u),
e AS ({_without_notice('f', 'form', 'rid, is_whole')}),
m AS (SELECT rid, is_whole, digest, license_id FROM e JOIN known ON digest = sha256(clean)
      WHERE clean <> ''),
g AS (SELECT rid, max(license_id) FILTER (is_whole) AS whole_license,
             string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses,
             count(DISTINCT digest) AS n_units FROM m GROUP BY rid)
SELECT doc_id, whole_license, coalesce(licenses, '') AS licenses,
       CAST(coalesce(n_units, 0) AS BIGINT) AS n_units
FROM d LEFT JOIN g USING (rid)
"""

STATEMENTS = {"op3_embeddings": OP3, "op7_mixing": OP7, "op8_licenses": OP8, "op9_decontaminate": OP9,
              "op12_phrases": OP12}
