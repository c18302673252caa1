"""Registered queries of the subpackage: thin digests over the operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import new_path
from .decontam import find_leaks
from .extraction import extract_pages
from .mixing import MixTargets, mix_sources, token_count
from .ngram_join import ngram_join
from .packing import packed_digest
from .pieces import encode_texts, read_model
from .pitman_yor import score_texts
from .pivots import CLUSTERS, centroid_digest, cluster_vectors
from .shards import shard_rows
from .substring_dedup import MARK, SENTENCES, WORDS, dedup_substrings
from .tandem import periodic_runs
from .toxicity import fit_toxicity, labelled_sample, score_toxicity
from .vector_dedup import near_vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_doc: the smallest document that holds the first place of a removed run; the document itself if none was removed."""
    found = dedup_substrings(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_sentences", "n_removed", F.coalesce(F.array_min("first_docs"), "doc_id").alias("first_doc"))


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(_table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

MIX_LEVELS = ["mix_domain__", "lang", "source"]
MIX = MixTargets(percent=80, max_epochs=3, seed=7, default=1, weights={
    "mix_domain__": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2}})


def with_domain(docs: DataFrame) -> DataFrame:
    """Domain of a document: the number of its source modulo 4 (sources without number: none)."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "[0-9]+", 0)
    return docs.withColumn("mix_domain__", F.when(number != "", F.concat(F.lit("d"), number.cast("long") % 4)).otherwise("none"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", token_count(F.col("text")).alias("n_tokens")))
    return mix_sources(docs, MIX_LEVELS, MIX, tokens=F.col("n_tokens")).select("doc_id", F.col("mix_domain__").alias("domain"), "lang", "source", "n_tokens", "mix_epoch")


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(_table(spark, sf_dir, "documents"), VOCABULARY, new_path(spark, "packed"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(labelled_sample(docs, _table(spark, sf_dir, "labels")))
    return score_toxicity(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"),
        F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"), F.col("toxic_matches").alias("matches"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaked_items") > 0).alias("contaminated"), F.col("leaked_items").alias("item_ids"), F.round("leaked_share", 4).alias("share"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, 16, ["doc_id"], seed=20).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


PIECE_MODEL = "piece_bpe_32k.model"


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = read_model(spark, public_tokenizers.path(PIECE_MODEL))
    docs = encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), model, ids_col="ids", decoded_col="decoded")
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroids' table has one row per cluster, CLUSTERS at most, so it is broadcast."""
    found, centroids = cluster_vectors(_table(spark, sf_dir, "embeddings"), clusters=CLUSTERS)
    inertia = sum(c["inertia"] for c in centroids)
    table = spark.createDataFrame(
        [(c["cluster"], c["inertia"], inertia, centroid_digest(c["components"])) for c in centroids],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


WORD = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of documents whose hash of the id ends in 0: from word a on, the first p words from there again and again."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    t = docs.select("doc_id", "text", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), 0)).alias("w"), g.alias("g"))
    t = t.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    t = t.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return t.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exponents are compared as whole-number products; runs come sorted by start and period, so the first of equals is taken."""
    found = periodic_runs(with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text")), name="r").select("doc_id", "r.*")
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("b", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period",
        F.floor(1000 * F.col("b.length") / F.col("b.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# CRC-32 from its rule (reversed polynomial 0xEDB88320), then the permutation with one recursion step per round;
# a walk past the table goes on with round 0. Row numbers follow doc_id.
SHARD_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i)),
docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS n FROM documents),
sums AS (
  SELECT doc_id, n, octet_length(encode(text)) + 1 AS size,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM docs, crc_table),
grid AS (SELECT total, wide, (total + wide - 1) // wide AS high FROM (SELECT count(*) AS total, ceil(sqrt(count(*)))::BIGINT AS wide FROM documents)),
walk AS (
  SELECT n, n // high AS l, n % high AS r, 0 AS k FROM docs, grid
  UNION ALL
  SELECT n,
         CASE WHEN k % 2 = 0 THEN (l + ('0x' || substr(md5('20:' || k || ':' || r), 1, 15))::BIGINT % wide) % wide ELSE l END,
         CASE WHEN k % 2 = 0 THEN r ELSE (r + ('0x' || substr(md5('20:' || k || ':' || l), 1, 15))::BIGINT % high) % high END,
         k + 1
  FROM (SELECT n, l, r, CASE WHEN k = 8 THEN 0 ELSE k END AS k FROM walk, grid WHERE k < 8 OR l * high + r >= total) AS w, grid),
placed AS (SELECT n, l * high + r AS place FROM walk, grid WHERE k = 8 AND l * high + r < total)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
       (place % 16)::INTEGER AS shard, (place // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM sums JOIN placed USING (n)
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
steps AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, s.y FROM reach r JOIN steps s ON r.y = s.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

COSINE_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
"""


def _lloyd_sql(clusters: int, rounds: int) -> str:
    """Distances as dot products, whole numbers below 2**53 in double precision."""
    def assign(k: int) -> str:
        return f"""
near{k} AS (SELECT rid, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (
  SELECT rid, c, list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, y.v) + list_dot_product(y.v, y.v) AS d FROM vectors x, centers{k} y) GROUP BY rid)"""

    def update(k: int) -> str:
        return f"""
means{k} AS (SELECT c, list(m ORDER BY i) AS v FROM (
  SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM near{k - 1} JOIN vectors USING (rid)) GROUP BY c, i) GROUP BY c),
centers{k} AS (SELECT c, coalesce(m.v, o.v) AS v FROM centers{k - 1} o LEFT JOIN means{k} m USING (c))"""

    return f"""
WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(v, lambda x: floor(64 * x)) AS v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x) OR abs(x) >= 1048576)) = 0),
centers0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM vectors) ORDER BY h, v LIMIT {clusters}),
{assign(0)},{",".join(update(k) + "," + assign(k) for k in range(1, rounds + 1))},
sums AS (SELECT c, sum(d) AS total FROM near{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, total::BIGINT AS cluster_inertia, (SELECT sum(total) FROM sums)::BIGINT AS inertia,
       sha256(array_to_string(list_transform(y.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM near{rounds} JOIN vectors USING (rid) JOIN sums USING (c) JOIN centers{rounds} y USING (c)
"""


REPEATS_SQL = rf"""
WITH units AS (
  SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[ \x09-\x0D]*[^ \x09-\x0D]+[ \x09-\x0D]*'), lambda u, i: {{'u': u, 'i': i}})) AS x FROM documents),
spelt AS (SELECT doc_id, x.i AS i, x.u AS u, translate(regexp_extract(x.u, '[^ \x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM units),
sums AS (
  SELECT w, list_sum(list_transform(regexp_extract_all(hex(w), '..'),
    lambda h: 16 * instr('123456789ABCDEF', h[1]) + instr('123456789ABCDEF', h[2]))) AS s
  FROM (SELECT DISTINCT w FROM spelt)),
closing AS (
  SELECT doc_id, i, u, w, s % {MARK} = 0 AS mark, w[-1] IN ('.', '!', '?') OR contains(regexp_extract(u, '[ \x09-\x0D]*$'), chr(10)) AS stop FROM spelt JOIN sums USING (w)),
cut AS (SELECT *, count(*) FILTER (mark OR stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS pos FROM closing),
sentences AS (SELECT doc_id, pos, string_agg(u, '' ORDER BY i) AS part, list(w ORDER BY i) AS w, bool_or(stop) AS stop FROM cut GROUP BY doc_id, pos),
counted AS (
  SELECT *, sum(len(w)) OVER o AS upto, sum(len(w)) OVER o - len(w) AS before, count(*) FILTER (stop) OVER o - stop::INT AS stops,
         count(*) OVER (PARTITION BY doc_id) AS n FROM sentences WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
texts AS (SELECT doc_id, list(array_to_string(w, ' ') ORDER BY pos) AS s, list(CASE WHEN stop THEN chr(2) ELSE chr(1) END ORDER BY pos) AS e FROM sentences GROUP BY doc_id),
ends AS (SELECT doc_id, stops AS k, min(pos) AS low, max(pos) AS high FROM counted GROUP BY doc_id, stops),
forth AS (
  SELECT c.doc_id, c.pos AS i, least(coalesce(m.pos, c.n + 1), greatest(coalesce(r.pos, c.n + 1), coalesce(x.low, c.n + 1))) AS j, c.n
  FROM counted c ASOF LEFT JOIN counted r ON c.doc_id = r.doc_id AND r.upto >= c.before + {WORDS}
  ASOF LEFT JOIN counted m ON c.doc_id = m.doc_id AND m.upto >= c.before + {2 * WORDS}
  LEFT JOIN ends x ON c.doc_id = x.doc_id AND x.k = c.stops + {SENTENCES - 1}),
back AS (
  SELECT c.doc_id, greatest(coalesce(m.pos, 0), least(coalesce(r.pos, 0), coalesce(x.high, 0))) AS i, c.pos AS j
  FROM counted c ASOF LEFT JOIN counted r ON c.doc_id = r.doc_id AND r.before <= c.upto - {WORDS}
  ASOF LEFT JOIN counted m ON c.doc_id = m.doc_id AND m.before <= c.upto - {2 * WORDS}
  LEFT JOIN ends x ON c.doc_id = x.doc_id AND x.k = c.stops - {SENTENCES - 1}),
runs AS (SELECT doc_id, i, j FROM forth WHERE j <= n UNION SELECT doc_id, i, j FROM back WHERE i >= 1),
keyed AS (SELECT runs.*, array_to_string(list_transform(range(i, j + 1), lambda k: s[k] || CASE WHEN k < j THEN e[k] ELSE '' END), '') AS key FROM runs JOIN texts USING (doc_id)),
placed AS (SELECT *, first_value({{'d': doc_id, 'i': i}}) OVER (PARTITION BY key ORDER BY doc_id, i) AS f FROM keyed),
again AS (SELECT doc_id, i, j, f.d AS source FROM placed WHERE f.d <> doc_id OR f.i <> i),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS pos FROM again),
sources AS (SELECT doc_id, min(source) AS first_doc FROM again GROUP BY doc_id),
kept AS (
  SELECT doc_id, count(*) AS n, count(gone.pos) AS removed, string_agg(part, '' ORDER BY sentences.pos) FILTER (gone.pos IS NULL) AS rest
  FROM sentences LEFT JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CASE WHEN removed > 0 THEN rtrim(coalesce(rest, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE text END AS text,
       coalesce(n, 0)::INTEGER AS n_sentences, coalesce(removed, 0)::INTEGER AS n_removed, coalesce(first_doc, doc_id) AS first_doc
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN sources USING (doc_id)
"""


def _share_sql(depth: int) -> str:
    """Budgets of one tree level from those of the level above."""
    keys = [f"l{i}" for i in range(depth + 1)]
    above = ", ".join(keys[:-1])
    part = f"PARTITION BY {above}" if above else ""
    level = MIX_LEVELS[depth]
    weight = f"CASE l{depth} " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in MIX.weights[level].items()) + f" ELSE {MIX.default} END"
    give = f"JOIN (SELECT {above}, got AS give FROM share{depth - 1}) AS p USING ({above})" if above else \
        f"CROSS JOIN (SELECT sum(tokens) * {MIX.percent} // 100 AS give FROM leaves) AS p"
    return f"""
node{depth} AS (SELECT {', '.join(keys)}, sum(tokens) * {MIX.max_epochs} AS cap, {weight} AS w FROM leaves GROUP BY ALL),
run{depth} AS (SELECT *, greatest(0, give - coalesce(sum(cap) OVER before, 0)) AS rest, sum(w) OVER onward AS ws FROM node{depth} {give}
  WINDOW before AS ({part} ORDER BY cap / w, l{depth} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         onward AS ({part} ORDER BY cap / w, l{depth} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
open{depth} AS (SELECT *, first(CASE WHEN cap * ws > rest * w THEN [rest, ws] END IGNORE NULLS) OVER ({part} ORDER BY cap / w, l{depth} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o FROM run{depth}),
share{depth} AS (SELECT {', '.join(keys)}, CASE WHEN cap * ws <= rest * w THEN cap ELSE least(cap, o[1] * w // o[2]) END AS got FROM open{depth})"""


MIX_SQL = rf"""
WITH docs AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS n_tokens,
         CASE WHEN regexp_extract(coalesce(source, ''), '[0-9]+') = '' THEN 'none' ELSE 'd' || (regexp_extract(source, '[0-9]+')::BIGINT % 4) END AS domain FROM documents),
keyed AS (SELECT *, domain AS l0, coalesce(lang, '') AS l1, coalesce(source, '') AS l2 FROM docs),
leaves AS (SELECT l0, l1, l2, sum(n_tokens)::HUGEINT AS tokens FROM keyed GROUP BY ALL),
{",".join(_share_sql(i) for i in range(3))},
plan AS (SELECT l0, l1, l2, CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN got % tokens ELSE got END AS rest FROM share2 JOIN leaves USING (l0, l1, l2)),
placed AS (SELECT *, ('0x' || substr(md5('{MIX.seed}:' || epochs || ':' || doc_id), 1, 15))::BIGINT AS place FROM keyed JOIN plan USING (l0, l1, l2)),
counted AS (SELECT *, epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY l0, l1, l2 ORDER BY place) <= rest THEN 1 ELSE 0 END AS copies FROM placed)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, unnest(range(copies::BIGINT))::INTEGER AS mix_epoch FROM counted
"""

QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_pitman_yor": op2_pitman_yor, "op3_vector_dedup": op3_vector_dedup, "op4_html_text": op4_html_text, "op5_mixing": op5_mixing, "op7_token_packing": op7_token_packing, "op6_toxicity": op6_toxicity, "op8_ngram_join": op8_ngram_join, "op9_decontamination": op9_decontamination, "op10_feistel_shards": op10_feistel_shards, "op11_pieces": op11_pieces, "op12_pivot_clusters": op12_pivot_clusters, "op13_periodic_runs": op13_periodic_runs}
ORACLES: dict[str, str] = {"op1_substring_dedup": REPEATS_SQL, "op3_vector_dedup": COSINE_SQL, "op8_ngram_join": JACCARD_SQL, "op5_mixing": MIX_SQL, "op10_feistel_shards": SHARD_SQL, "op12_pivot_clusters": _lloyd_sql(CLUSTERS, 3)}
