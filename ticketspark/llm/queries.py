"""The numbered operators as queries over the given tables: ``name -> f(spark, sf_dir)``, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketspark.llm import (
    bagminhash, bitsliced, exact_dedup, maxent_lm, merkle_manifest, mixing, phrase_stripes, pieces, shard_shuffle, simple8b,
    substring_dedup, toxicity, warc,
)
from ticketspark.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the machine keeps the public vocabulary files."""
    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


@query
def op4_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = simple8b.write_token_files(docs, simple8b.token_folder(docs), vocabulary("word_bpe_49k.json"))
    return simple8b.token_summary(files)


@query
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("length")


ORACLES["op6_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query
def op7_sentencepiece(spark, sf_dir):
    whole = pieces.encode_and_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    return whole.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_top_k(spark, sf_dir):
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op1_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op2_warc(spark, sf_dir):
    packages = warc.write_packages(table(spark, sf_dir, "pages"), scratch_path(spark, "packages"))
    return warc.read_packages(packages).drop("url")


ORACLES["op2_warc"] = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS last_id FROM p
)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         ((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT)) >> CAST(15 - i % 4 * 5 AS INTEGER)) % 32 + 1 AS INTEGER), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM m
"""


@query
def op3_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS p, ws FROM d WHERE len(ws) >= 35
), h AS (
  SELECT doc_id, p, sha256(array_to_string(ws[p:p + 34], ' ')) AS h FROM w
), g AS (
  SELECT h FROM h GROUP BY h HAVING count(*) > 1
), r AS (
  SELECT DISTINCT doc_id, p + k AS q FROM h JOIN g USING (h), (SELECT unnest(range(35)) AS k)
), t AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS q FROM d
), k AS (
  SELECT t.doc_id, t.q, t.ws[t.q] AS word, r.q IS NOT NULL AS gone FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND t.q = r.q
), s AS (
  SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
         string_agg(word, ' ' ORDER BY q) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""


@query
def op8_near_duplicates(spark, sf_dir):
    documents, _, _ = bagminhash.near_duplicates(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "class_id", "class_size", "kept")


@query
def op9_maxent_lm(spark, sf_dir):
    return maxent_lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op5_mix_sources(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "epoch", "n_tokens", "start", "place")


@query
def op11_shards(spark, sf_dir):
    return shard_shuffle.shard_of_documents(table(spark, sf_dir, "documents"))


@query
def op12_merkle(spark, sf_dir):
    return merkle_manifest.verified_manifest(table(spark, sf_dir, "documents"))


ORACLES["op12_merkle"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source,
    concat_ws('', coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
    text, replace(text, chr(10), '') AS joined,
    list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda x: list_transform(range(8), lambda i: (CAST(ascii(x) AS BIGINT) >> CAST(i AS INTEGER)) % 2))),
      lambda c, bit: CASE WHEN xor(c % 2, bit) = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295) AS c
  FROM documents
), l AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(c, 4294967295) % 2 = 0 THEN sha256(head || coalesce(strlen(joined) || ':' || joined, '-'))
         ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen
  FROM d
), r AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n
  FROM l
), nodes AS (
  SELECT grp, 0 AS level, rank AS place, n, leaf AS digest FROM r
  UNION ALL
  SELECT grp, any_value(level) + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY grp, place // 3
), subs AS (
  SELECT grp, digest, level AS height FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, grp AS place, (SELECT count(*) FROM subs) AS n, digest FROM subs
  UNION ALL
  SELECT any_value(level) + 1, place // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY place // 3
), fold AS (
  SELECT doc_id, leaf, grp, rank, 0 AS level, rank AS place, n, seen AS node, '' AS proof FROM r
  UNION ALL
  SELECT f.doc_id, f.leaf, f.grp, f.rank, f.level + 1, f.place // 3, (f.n + 2) // 3,
    sha256(coalesce(s.digests_left, '') || f.node || coalesce(s.digests_right, '')),
    f.proof || coalesce(s.digests_left, '') || coalesce(s.digests_right, '')
  FROM fold f, LATERAL (
    SELECT string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place < f.place) AS digests_left,
           string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place > f.place) AS digests_right
    FROM nodes x WHERE x.grp = f.grp AND x.level = f.level AND x.place // 3 = f.place // 3) s
  WHERE f.n > 1
), high AS (
  SELECT f.doc_id, f.leaf, f.grp, f.rank, 0 AS level, f.grp AS place, (SELECT count(*) FROM subs) AS n, f.node, f.proof FROM fold f WHERE f.n = 1
  UNION ALL
  SELECT f.doc_id, f.leaf, f.grp, f.rank, f.level + 1, f.place // 3, (f.n + 2) // 3,
    sha256(coalesce(s.digests_left, '') || f.node || coalesce(s.digests_right, '')),
    f.proof || coalesce(s.digests_left, '') || coalesce(s.digests_right, '')
  FROM high f, LATERAL (
    SELECT string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place < f.place) AS digests_left,
           string_agg(x.digest, '' ORDER BY x.place) FILTER (x.place > f.place) AS digests_right
    FROM tops x WHERE x.level = f.level AND x.place // 3 = f.place // 3) s
  WHERE f.n > 1
), root AS (
  SELECT digest AS root FROM tops WHERE n = 1
)
SELECT h.doc_id, h.leaf, s.digest AS subroot, root, sha256(h.proof) AS proof_sha256, h.node AS folded_root, h.node = root AS verified
FROM high h JOIN subs s USING (grp), root WHERE h.n = 1
"""


@query
def op13_collocations(spark, sf_dir):
    return phrase_stripes.collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, ws
  FROM (
    SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')), '[^ 	]+') AS ws
    FROM documents)
  WHERE len(ws) > 0
), g AS (
  SELECT lang, m, ws[i:i + m - 1] AS words
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p), (SELECT unnest(range(1, 5)) AS m)
  WHERE i + m - 1 <= len(ws)
), f AS MATERIALIZED (
  SELECT lang, m, words, count(*) AS f FROM g GROUP BY lang, m, words
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, m, words, f AS a FROM f WHERE m > 1 AND f >= 30
), inside AS (
  SELECT lang, m - d AS m, words[1 + o:m - d + o] AS words, max(a) AS longer
  FROM c, (SELECT unnest(range(1, 3)) AS d), (SELECT unnest(range(0, 3)) AS o) WHERE o <= d AND m - d > 1 GROUP BY ALL
), cut AS MATERIALIZED (
  SELECT lang, words, a, k, words[1:k] AS head, words[k + 1:m] AS tail
  FROM (SELECT lang, m, words, a, unnest(range(1, m)) AS k FROM c)
), k AS (
  SELECT cut.lang, cut.words, a, k, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * a // (l.f + r.f) AS BIGINT) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.words = head JOIN f r ON r.lang = cut.lang AND r.words = tail
), s AS (
  SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), t AS (
  SELECT s.lang, array_to_string(s.words, ' ') AS phrase, a, l, r, n, score
  FROM s JOIN n USING (lang) LEFT JOIN inside i ON i.lang = s.lang AND i.words = s.words
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM t QUALIFY rank <= 2000
"""
