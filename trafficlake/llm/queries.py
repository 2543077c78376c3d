"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    impact_search, lines, minhash, mixing, near_vectors, packing, quality, ranked_search, repeats, spelling, token_codes, token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_NEAR_VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
  r(vec_id, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.vec_id),
  c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

_NEAR_TEXT_SQL = """WITH RECURSIVE d AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id),
  c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# levenshtein of SQL counts bytes, so letters beyond ASCII are exchanged for ASCII signs that no word holds.
_WIDE, _NARROW = "".join(map(chr, range(0xC0, 0x100))), "0123456789" + _UPPER + "!#$%&()*+,-./:;<=>?@[]^_{|}~"

_SPELLING_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
  o AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM d WHERE length(run) >= 6 GROUP BY 1, 2),
  b AS (SELECT run, n, list_prepend(4294967295, flatten(list_transform(range(length(x) // 2), lambda i: [CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))) AS e FROM o),
  h AS (SELECT run, n, xor(list_reduce(e, lambda c, y: xor(xor(c, y) >> 1, (xor(c, y) & 1) * 3988292384)), 4294967295) AS h FROM b),
  k AS (SELECT n, CASE WHEN h % 199 = 0 THEN substring(run, 1, CAST(h % length(run) AS INTEGER)) || substring(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM h),
  w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS l, translate(word, '{_WIDE}', '{_NARROW}') AS t FROM k WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
  a AS (SELECT *, unnest([l - 1, l, l + 1]) AS m FROM w),
  p AS (SELECT a.word, a.n, z.word AS near, z.n AS near_n FROM a JOIN w z ON z.l = a.m AND z.word <> a.word AND levenshtein(a.t, z.t) = 1),
  q AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM p),
  f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
    FROM w LEFT JOIN q ON q.word = w.word AND q.r = 1),
  g(word, root) AS (SELECT word, word FROM f UNION SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, g.root FROM f JOIN g ON g.word = f.word JOIN f e ON e.word = g.root AND e.form IS NULL"""

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_RANKED_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}') AS w FROM documents WHERE text IS NOT NULL),
  s AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
  g AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM s),
  t AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
  i AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS t FROM benchmark)),
  x AS (SELECT t, CAST(floor(1000 * ln((2 * c + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM t GROUP BY 1), g),
  p AS (SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * c) // l)))) AS BIGINT) AS score
    FROM i JOIN x USING (t) JOIN t USING (t) JOIN s USING (r), g GROUP BY 1, 2, 3),
  k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM k WHERE rank <= 50"""


@query("op1_nnpu_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_impact_topk", _TOPK_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_search.top_k(table(spark, sf_dir, "embeddings"))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_token_codes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_source_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


@query("op6_pca_near_vectors", _NEAR_VECTORS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(table(spark, sf_dir, "embeddings"))


@query("op7_bwt_repeats")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Cuts can fall inside a character: what is left of one is shown as U+FFFD in ``text``; the hash is of the bytes.
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=True)
    return kept.withColumn("text", F.expr("make_valid_utf8(CAST(kept AS STRING))")).drop("kept", "spans")


@query("op8_line_winnowing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeated_lines(table(spark, sf_dir, "documents")).drop("text")


@query("op9_hyperminhash", _NEAR_TEXT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op10_additive_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_pivotal_spellings", _SPELLING_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


@query("op13_interval_search", _RANKED_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
