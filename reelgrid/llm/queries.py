"""One query per operator over the given tables, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_trie import prefix_trie
from .decontaminate import contamination
from .exact_dup import exact_duplicates
from .language import identify
from .lm_score import cross_entropy_difference
from .mixing import draw
from .near_dup import near_duplicates
from .phrases import collocations
from .pii import personal_data
from .resample import importance_sample
from .toxicity import toxicity
from .vector_dup import near_vectors
from .warc import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_benchmark_decontamination", rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS t FROM iw WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM win
), grams AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k
), hits AS (SELECT doc_id, item_id, i, g.k FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM grams) g JOIN win ON g.t = win.t AND g.k = win.k
), hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), length=10).drop("n_near")


@query("op3_minhash_near_dedup", rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM items p JOIN items q ON p.x = q.x AND p.doc_id <> q.doc_id AND 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM sets LEFT JOIN least_id ON doc_id = a""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


@query("op2_importance_resampling")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


@query("op5_lm_cross_entropy_difference")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where("quality = 1"))


@query("op6_vector_near_dedup", """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
    coalesce(label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good
  FROM embeddings
), links AS (
  SELECT p.r AS a, q.r AS b, q.vec_id AS id FROM v p JOIN v q ON p.label = q.label AND p.r <> q.r AND p.good AND q.good AND len(p.e) = len(q.e)
  WHERE list_cosine_similarity(p.e, q.e) >= 0.93
), reach AS (SELECT a, b, id FROM links UNION SELECT x.a, l.b, l.id FROM reach x JOIN links l ON x.b = l.a
), least_id AS (SELECT a, min(id) AS id FROM reach GROUP BY a
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(id, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(id, vec_id)) AS kept
FROM v LEFT JOIN degree ON degree.a = r LEFT JOIN least_id ON least_id.a = r""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = draw(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "shards")


@query("op10_warc_round_trip", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR) AS b FROM pages
), g AS (SELECT page_id, h, b, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM g""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"), least=0)


@query("op7_pii")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


@query("op11_phrase_collocations", rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), ws AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM ws GROUP BY lang
), grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM ws, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, cut, x.f AS l, y.f AS r, CAST(CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
), scored AS (SELECT lang, phrase, a, unnest(min(row(score, cut, l, r))) FROM cuts GROUP BY lang, phrase, a
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f FROM (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k = 3)
), cover AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL
), kept AS (SELECT s.lang, s.phrase, a, s.element3 AS l, s.element4 AS r, s.element1 AS score FROM scored s LEFT JOIN cover c ON c.lang = s.lang AND c.phrase = s.phrase WHERE c.f IS NULL OR 100 * c.f < 50 * a
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"), shortest=2, longest=3, least=10, cover_percent=50, top=2000)


@query("op12_exact_dedup", f"""
WITH t AS (SELECT doc_id, {_LOWER} AS x, row_number() OVER () AS r FROM documents
), g AS (SELECT doc_id, x, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST, r) AS nth FROM t)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(x) AS text_sha256 FROM g""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), keep="largest")


@query("op13_conversation_trie", """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
    lambda x, y: list_reduce(list_concat([xor(x, y)], range(8)), lambda p, q: CASE WHEN p % 2 = 1 THEN xor(p // 2, 3988292384) ELSE p // 2 END)) AS crc FROM (SELECT DISTINCT c FROM t)
), plan AS (SELECT c, c - c % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM convs
), parts AS (
  SELECT plan.c, 0 AS own, i, role, text FROM plan JOIN t ON t.c = plan.base WHERE i <= h UNION ALL SELECT plan.c, 1, i, role, text FROM plan JOIN t ON t.c = plan.c WHERE i > h
), built AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, role, text FROM parts
), chain AS (SELECT c, d, length(text) AS chars, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d) AS p FROM built
), steps AS (SELECT c, d, chars, p FROM chain UNION ALL SELECT c, 0, 0, [] FROM plan
), nodes AS (SELECT p, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(chars) AS chars FROM steps GROUP BY p
), kids AS (SELECT p[:len(p) - 1] AS p, count(*) AS n FROM nodes WHERE len(p) > 0 GROUP BY 1
), own AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p)
), up AS (SELECT p[:unnest(range(0, len(p) + 1))] AS p, n_children, (n_convs - 1) * chars AS saved FROM own
), sums AS (SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY p
), ends AS (SELECT p, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS e FROM (SELECT c, arg_max(p, d) AS p FROM steps GROUP BY c) GROUP BY p)
SELECT own.conv_id, CAST(own.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM own LEFT JOIN nodes parent ON len(own.p) > 0 AND parent.p = own.p[:len(own.p) - 1] JOIN sums ON sums.p = own.p LEFT JOIN ends ON ends.p = own.p""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))
