"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cascade, fingerprints, jaccard, langid, media, mixing, packing, periodic, token_counts, token_files, toxicity, urlblock, whitening
from .common import WORD as WORDS
from .common import Scratch, id_crc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, by models of the rows that aren't held out. Null texts and texts without a letter: und."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, learn=~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 2048 ids. Null text: its end id alone; repeated rows and null ids are rows like others."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's counts and the cascade's verdict. Null text: no words, so it fails."""
    return cascade.judge(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component under links of 85 % of common 4-word shingles. Texts without words: alone; odd rows: see jaccard.near_duplicates."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), jaccard.Params(words=4, percent=85))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a label of every text, by a model of labelled rows that aren't held out. Odd rows: see toxicity.score."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as its files give them back. Null text: the end id alone; odd rows: see token_files."""
    path = Scratch(spark, "tokens").path("table")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.with_crc(token_files.read_token_files(spark, path))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited form. Odd rows: see fingerprints.fingerprint_edits."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, in training order. Odd rows: see mixing.mix."""
    scratch = Scratch(spark, "mix")
    words = scratch.write(mixing.sized(table(spark, sf_dir, "documents")), "words")
    rows = mixing.by_first_position(mixing.mix(table(spark, sf_dir, "documents"), words=words))
    first = F.round(F.try_element_at("positions", F.lit(1)), 9)
    return rows.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), F.size("positions").cast("long").alias("repeats"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by rules and aliases. Null or odd addresses: empty host and path, allowed."""
    return urlblock.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes and tokens. Null text: none; odd rows: see token_counts.count_tokens."""
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a wave file in content-defined chunks, and what its stored bytes say. Odd rows: see media.text_media."""
    return media.text_media(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every usable embedding. Odd rows: see whitening.whiten."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents, chosen by a hash of the id, repeat a stretch of words to their end. A null id
    hashes like empty text."""
    hashed = docs.select("doc_id", "text", id_crc(F.col("doc_id")).alias("h")).withColumn("g", F.expr("h div 10"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORDS})"), F.lit(1)))
    n = F.col("n")
    placed = hashed.withColumn("words", words).withColumn("n", F.size("words")).withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    placed = placed.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    again = F.expr("concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), CAST((n - a + p - 1) div p AS INT))))")
    return placed.select("doc_id", F.when(n > 0, F.array_join(F.slice(again, F.lit(1), n), " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, some of which repeat a stretch to their end. Odd rows: see periodic.collapse; a text without words
    stays as it is."""
    return periodic.digests(periodic.collapse(planted(table(spark, sf_dir, "documents"))), "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_packing, op3_quality_rules, op4_ngram_jaccard, op5_toxicity, op6_token_files, op7_fingerprints, op8_mixing, op9_url_filters, op10_token_counts, op11_media_chunks, op12_whitening, op13_periodic_runs)
}

WORD = "'[^\\x20\\x09-\\x0D]+'"

ORACLES = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, {WORD}) AS words FROM d),
g AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS gram FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines,
      coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines
      FROM w LEFT JOIN c USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 60 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM f
""",
    "op4_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{urlblock.UPPER}', '{urlblock.LOWER}'), {WORD}) AS words FROM documents),
s AS (SELECT DISTINCT rid, gram FROM (SELECT rid, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' ')) END) AS gram FROM w)),
n AS (SELECT w.rid, w.doc_id, count(gram)::BIGINT AS n FROM w LEFT JOIN s USING (rid) GROUP BY w.rid, w.doc_id),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS n_both FROM s x JOIN s y USING (gram) WHERE x.rid <> y.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
c AS (SELECT t.a AS rid, min(n.doc_id) AS least FROM t JOIN n ON n.rid = t.b GROUP BY 1)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id FROM n LEFT JOIN c USING (rid)
""",
    "op8_mixing": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, 't') AS key, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS w,
        [-0.5::DOUBLE, 0, 0.5][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS slope FROM d GROUP BY key),
b AS (SELECT *, 3 * source_size AS cap FROM s),
k AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE AS room, (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS w_left
      FROM b WINDOW before AS (ORDER BY cap::DOUBLE / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, room / w_left AS level, cap <= room / w_left * w AS capped FROM k),
g AS (SELECT key, source_size, slope, CASE WHEN capped THEN cap::DOUBLE ELSE (arg_max(level, w_left) FILTER (WHERE NOT capped) OVER ()) * w END AS target FROM q),
o AS (SELECT d.*, source_size, target, slope, coalesce(sum(size) OVER (PARTITION BY key ORDER BY place, doc_id NULLS FIRST, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN g USING (key))
SELECT doc_id, size, source_size, target,
       (SELECT sum(greatest(0, least(size, floor(target + 0.5)::BIGINT - ahead - x.i * source_size))) FROM (SELECT unnest([0, 1, 2]) AS i) x)::BIGINT AS taken,
       CASE WHEN size > 0 AND floor(target + 0.5)::BIGINT > ahead
            THEN round(2 * (ahead::DOUBLE / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (ahead::DOUBLE / target))), 9) END AS first_position,
       (SELECT count(*) FROM (SELECT unnest([0, 1, 2]) AS i) x WHERE size > 0 AND floor(target + 0.5)::BIGINT - ahead - x.i * source_size > 0)::BIGINT AS repeats
FROM o
""",
    "op9_url_filters": rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, translate(coalesce(regexp_extract(url, '{urlblock.URL}', 1), ''), '{urlblock.UPPER}', '{urlblock.LOWER}') AS host,
        coalesce(regexp_extract(url, '{urlblock.URL}', 2), '') AS path FROM pages),
e AS (SELECT url, regexp_extract(html, '{urlblock.CANONICAL.replace("'", "''")}') AS link, regexp_extract(html, '{urlblock.REFRESH.replace("'", "''")}') AS refresh
      FROM pages WHERE url IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
f AS (SELECT url, replace(t, '&amp;', '&') AS t FROM (SELECT url, unnest([regexp_extract(link, '{urlblock.HREF.replace("'", "''")}', 1), regexp_extract(refresh, '{urlblock.REFRESH_URL.replace("'", "''")}', 1)]) AS t FROM e) WHERE t <> ''),
h AS (SELECT url, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || t
        WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || t
        ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*') || coalesce(nullif(regexp_extract(regexp_extract(url, '{urlblock.URL}', 2), '(?s)^.*/'), ''), '/') || t END AS t FROM f),
i AS (SELECT regexp_replace(url, '(?s)#.*$', '') AS a, regexp_replace(t, '(?s)#.*$', '') AS b FROM h),
j AS (SELECT translate(regexp_extract(x, '(?s)^.*?://[^/?]*'), '{urlblock.UPPER}', '{urlblock.LOWER}') || substr(x, length(regexp_extract(x, '(?s)^.*?://[^/?]*')) + 1) AS a,
        translate(regexp_extract(y, '(?s)^.*?://[^/?]*'), '{urlblock.UPPER}', '{urlblock.LOWER}') || substr(y, length(regexp_extract(y, '(?s)^.*?://[^/?]*')) + 1) AS b FROM (SELECT a AS x, b AS y FROM i)),
k AS (SELECT a, b FROM j UNION SELECT b, a FROM j),
m AS (SELECT a, b FROM k UNION SELECT m.a, k.b FROM m JOIN k ON m.b = k.a),
o AS (SELECT DISTINCT node, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
      FROM (SELECT b AS node, regexp_extract(b, '{urlblock.URL}', 1) AS host, regexp_extract(b, '{urlblock.URL}', 2) AS path FROM m)),
a AS (SELECT DISTINCT m.a AS node FROM m JOIN o ON o.node = m.b WHERE o.rule IN ('net/', 'example.com/de/')),
r AS (SELECT p.*, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
      regexp_replace(url, '(?s)#.*$', '') AS bare FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN translate(regexp_extract(bare, '(?s)^.*?://[^/?]*'), '{urlblock.UPPER}', '{urlblock.LOWER}') || substr(bare, length(regexp_extract(bare, '(?s)^.*?://[^/?]*')) + 1) IN (SELECT node FROM a) THEN 'block' ELSE 'allow' END AS verdict
FROM r
""",
}
