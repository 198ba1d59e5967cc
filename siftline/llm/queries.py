"""Registered queries of the subpackage, and their DuckDB counterparts.

Each takes (spark, sf_dir), reads the whole table and applies one operator with
its production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.credentials import find_secrets, secret_columns
from siftline.llm.filter_audit import filter_audit
from siftline.llm.minhash import near_duplicates
from siftline.llm.mixing import mix_sources
from siftline.llm.periodic import periodic_runs, run_columns, with_planted_loops
from siftline.llm.pieces import decode, encode, load
from siftline.llm.pii import find_pii, pii_columns
from siftline.llm.pivot_topk import top_by_inner_product
from siftline.llm.sharding import stratified_shards
from siftline.llm.suffixes import repeated_passages
from siftline.llm.tile_search import nearest_by_tiles
from siftline.llm.token_files import read_documents, write_token_files
from siftline.llm.toxicity import held_out, toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_by_inner_product(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_tile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_tiles(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity_scores(docs, labels, may_learn=~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the spans, in words, of 50 words or more that other documents hold too."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", "copies", covered.alias("n_repeated"), F.array_join(spans, ",").alias("spans"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=85, shingle_words=3)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_columns(find_secrets(table(spark, sf_dir, "documents")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_columns(find_pii(table(spark, sf_dir, "documents")))

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = MODEL) -> DataFrame:
    """Ids of every text, and whether they decode to it again."""
    model = load(spark, model_path)
    encoded = table(spark, sf_dir, "documents").select("doc_id", "text", encode(F.col("text"), model).alias("token_ids"))
    decoded = encoded.withColumn("decoded", decode(F.col("token_ids"), model))
    same = F.col("decoded").eqNullSafe(F.col("text"))
    return decoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources evenly, as many documents as there are."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = stratified_shards(table(spark, sf_dir, "documents"))
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, a tenth of the texts with planted loops."""
    return run_columns(periodic_runs(with_planted_loops(table(spark, sf_dir, "documents"))))


WORD_TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def op13_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str = WORD_TOKENIZER) -> DataFrame:
    """Where each document's ids lie, and their checksums, as read back from the files."""
    return read_documents(write_token_files(table(spark, sf_dir, "documents"), tokenizer_path))


QUERIES |= {"op11_filter_audit": op11_filter_audit, "op12_periodic_runs": op12_periodic_runs, "op13_token_files": op13_token_files}
QUERIES |= {"op2_sharding": op2_sharding, "op3_sentencepiece": op3_sentencepiece, "op4_mixing": op4_mixing, "op10_pii": op10_pii, "op9_secrets": op9_secrets, "op1_pivot_topk": op1_pivot_topk, "op6_toxicity": op6_toxicity, "op7_suffixes": op7_suffixes, "op8_minhash": op8_minhash, "op5_tile_search": op5_tile_search}

_USABLE = """embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLES["op1_pivot_topk"] = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {_USABLE}
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
"""

ORACLES["op5_tile_search"] = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""

# A-Z only; DuckDB's lower() would change other letters as well
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op8_minhash"] = f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN []
        WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
        END AS shingles FROM w
), flat AS (
    SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS node, doc_id AS other FROM sets
    UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a
), low AS (
    SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN low ON low.node = sets.doc_id
"""


def _found(name: str, kind: str, pattern: str, condition: str = "true", order: int = 0) -> str:
    """A relation (doc_id, start, stop, value, kind, place) of a pattern's matches that meet a condition."""
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
    SELECT doc_id, start, start + length(value) AS stop, value, '{kind}' AS kind, {order} AS place FROM (
        SELECT doc_id, value, length(array_to_string(gaps[:i], '')) + length(array_to_string(vals[:i - 1], '')) AS start
        FROM (SELECT doc_id, gaps, vals, unnest(vals) AS value, unnest(range(1, len(vals) + 1)) AS i FROM (
            SELECT doc_id, regexp_split_to_array(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS vals
            FROM documents WHERE regexp_matches(text, '{quoted}')))
    ) WHERE {condition}
)"""


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_ASSIGN_2 = r"""^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PROVIDER = "(?:ghp|gho|ghu|ghs|ghr|glpat|xoxb|xoxp|sk_live|rk_live)[_-][A-Za-z0-9_-]{16,}"

ORACLES["op7_suffixes"] = f"""
WITH w AS (
    SELECT doc_id, text, regexp_extract_all(coalesce({_ASCII_LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), flat AS (
    SELECT doc_id, i - 1 AS start, words[i : i + 49] AS passage
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)
), marked AS (
    SELECT doc_id, start, md5(array_to_string(passage, ' ')) AS mark FROM flat
), repeated AS (
    SELECT doc_id, start FROM marked
    WHERE mark IN (SELECT mark FROM marked GROUP BY mark HAVING min(doc_id) <> max(doc_id))
), islands AS (
    SELECT doc_id, start, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS island
    FROM (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY doc_id ORDER BY start) + 50 THEN 0 ELSE 1 END AS fresh FROM repeated)
), spans AS (
    SELECT doc_id, island, min(start) AS a, max(start) + 50 AS b FROM islands GROUP BY ALL
), found AS (
    SELECT doc_id, sum(b - a) AS n, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, count(*) OVER (PARTITION BY text) AS copies,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeated, coalesce(spans, '') AS spans
FROM w LEFT JOIN found USING (doc_id)
"""

ORACLES["op9_secrets"] = f"""
WITH {_found("assign", "assign", _ASSIGN, f"length(regexp_extract(value, '{_ASSIGN_2}', 1)) >= 6", 1)},
{_found("access", "access", "AKIA[A-Z0-9]+", "length(value) >= 20", 2)},
{_found("hexes", "hex", "[0-9a-f]+", "length(value) >= 24", 3)},
{_found("provider", "provider", _PROVIDER, "true", 4)},
spans AS (
    SELECT *, kind || ':' || start || ':' || stop AS label,
        CASE WHEN kind = 'assign' THEN regexp_extract(value, '{_ASSIGN_2}', 1) ELSE value END AS secret
    FROM (FROM assign UNION ALL FROM access UNION ALL FROM hexes UNION ALL FROM provider)
), owners AS (
    SELECT secret, count(DISTINCT doc_id) AS repos, count(DISTINCT source) AS owners
    FROM spans JOIN documents USING (doc_id) GROUP BY secret
), judged AS (
    SELECT spans.*, owners <= 1 AND repos <= 3 AND regexp_matches(secret, '[0-9]') AND regexp_matches(secret, '[A-Za-z]')
        AND len(list_distinct(string_split(secret, ''))) >= 8
        AND NOT regexp_matches(secret, '(?i)example|changeme|placeholder|dummy|sample|your[_-]|x{{6,}}|0{{8,}}|1234567') AS live
    FROM spans JOIN owners USING (secret)
), rows AS (
    SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(label, ',' ORDER BY start, place) FILTER (place <= 3), '') AS base,
        coalesce(string_agg(label, ',' ORDER BY start, place) FILTER (place <= 3 OR live), '') AS spans,
        count(*) FILTER (live) AS n_live, count(*) FILTER (place <= 3 AND NOT live) AS n_copied
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
    coalesce(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN rows USING (doc_id)
"""

ORACLES["op4_mixing"] = """
WITH RECURSIVE rates AS (
    SELECT source, sum(count(*)) OVER () / CAST(count(*) OVER () AS DOUBLE) / count(*) AS rate FROM documents GROUP BY source
), steps AS (
    SELECT source, rate, 0 AS k, exp(-rate) AS mass, exp(-rate) AS below FROM rates
    UNION ALL
    SELECT source, rate, k + 1, mass * rate / (k + 1), below + mass * rate / (k + 1) FROM steps WHERE k < rate + 12 * sqrt(rate) + 29
), draws AS (
    SELECT *, CAST(('0x' || substr(md5('17|' || doc_id || '|draw|1'), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM documents
), counts AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(*) AS copies
    FROM draws d JOIN steps s ON s.source = d.source AND s.below <= d.u GROUP BY ALL
), copied AS (
    SELECT * EXCLUDE (copies), unnest(range(copies)) AS n FROM counts
)
SELECT doc_id, text, lang, source, n_chars, CAST(n AS INTEGER) AS copy, md5('17|' || doc_id || '|place|' || n) AS mix_key FROM copied
"""


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes: the table of 256 entries is linear, so eight of them give all."""
    powers = []
    for i in range(8):
        value = 1 << i
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        powers.append(value)
    entry = "0"
    for i, power in enumerate(powers):
        entry = f"xor({entry}, ((xor(acc, b) >> {i}) & 1) * {power})"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda acc, b: xor(acc >> 8, {entry})), 4294967295)"


ORACLES["op2_sharding"] = f"""
WITH d AS (
    SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32("coalesce(text, '')")} AS crc,
        md5('23|' || doc_id) AS h FROM documents
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, crc, size) - 1 + u) / count(*) OVER (PARTITION BY source) AS f FROM (
        SELECT *, (CAST('0x' || substr(md5('23|source|' || coalesce('s' || source, '')), 1, 5) AS BIGINT) + 0.5::DOUBLE) / 1048576::DOUBLE AS u FROM d)
), placed AS (
    SELECT *, row_number() OVER (ORDER BY f, source, h, crc, size) - 1 AS place, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
    CAST(place * 16 // n AS INTEGER) AS shard, CAST(place - (place * 16 // n * n + 15) // 16 AS BIGINT) AS slot,
    CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

_LETTERS = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"

ORACLES["op11_filter_audit"] = f"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d
), said AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
    SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c,
        regexp_matches(text, '[#$%&*|]') AS d, coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS e,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM w LEFT JOIN said USING (doc_id)
), cells AS (
    SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
        || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
        count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM f GROUP BY ALL
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM {_LETTERS} a(x), {_LETTERS} b(x), {_LETTERS} c(x), {_LETTERS} d(x), {_LETTERS} e(x)
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
), tried AS (
    SELECT part, filter_order, step, filter_order[step] AS filter, contains(fails, filter_order[step]) AS failing,
        len(list_filter(range(1, step), lambda i: contains(fails, filter_order[i]))) > 0 AS gone, length(fails) AS n_fails,
        n, good, toxic
    FROM cells, steps
), sums AS (
    SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept,
        coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
        coalesce(sum(n) FILTER (failing AND n_fails = 1), 0) AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS toxic_lost
    FROM tried GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM sums
"""
