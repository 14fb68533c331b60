"""Decontamination, deduplication, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import collapsed, draw, shingles, tokens
from ..operators import similarity as sim, vectors as vec
from . import query, table

#: Jaccard at which the decontamination queries drop; long documents and short probes make symmetric Jaccard small.
DROP = 0.05
NEAR = 0.85

_SHINGLES = r"""
t AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents
      UNION ALL SELECT 'p', item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') FROM benchmark),
s AS (SELECT side, id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE w END) AS s FROM t),
e AS (SELECT side, id, len(s) AS n, unnest(s) AS g FROM s),
o AS (SELECT d.id, p.id AS probe, d.n, p.n AS m, count(*) AS common FROM e d JOIN e p ON d.side = 'd' AND p.side = 'p' AND d.g = p.g GROUP BY ALL),
b AS (SELECT id, probe, common / (n + m - common)::DOUBLE AS score FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, probe) = 1),
r AS (SELECT d.doc_id, b.probe AS item_id, coalesce(b.score, 0.0) AS raw FROM documents d LEFT JOIN b ON b.id = d.doc_id)
"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _probes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    best = sim.decontaminate(_queries(spark, d), _probes(spark, d))
    return best.select(F.col("id").alias("doc_id"), F.col("probe").alias("item_id"), F.col("score").alias("raw"))


@query(f"WITH {_SHINGLES} SELECT doc_id, item_id, round(raw, 6) AS score, raw >= {DROP} AS contaminated FROM r")
def decontam_ngram_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its most similar probe."""
    return _scored(spark, sf_dir).select("doc_id", "item_id", F.round("raw", 6).alias("score"), (F.col("raw") >= DROP).alias("contaminated"))


@query(f"WITH {_SHINGLES} SELECT doc_id, round(raw, 3) AS score FROM r WHERE raw < {DROP}")
def decontam_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("raw") < DROP).select("doc_id", F.round("raw", 3).alias("score"))


@query(f"WITH {_SHINGLES} SELECT doc_id, item_id, round(raw, 3) AS score FROM r WHERE raw >= {DROP}")
def decontam_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("raw") >= DROP).select("doc_id", "item_id", F.round("raw", 3).alias("score"))


@query(f"WITH {_SHINGLES} SELECT id AS doc_id, probe AS item_id, round(common / m::DOUBLE, 6) AS containment FROM o WHERE common / m::DOUBLE >= 0.5")
def decontam_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: documents that contain at least half of a probe's shingles."""
    share = F.col("common") / F.col("m")
    return sim.overlap(_queries(spark, sf_dir), _probes(spark, sf_dir)).where(share >= 0.5).select(F.col("id").alias("doc_id"), F.col("probe").alias("item_id"), F.round(share, 6).alias("containment"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.query'), props) AS probe FROM events WHERE trim(coalesce(props, '')) <> ''")
def probe_text_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe lines: the ``query`` of a JSON object, else the raw line; blank lines are skipped."""
    from ..sources.readers import probe_text

    return table(spark, sf_dir, "events").where(F.trim(F.coalesce("props", F.lit(""))) != "").select("event_id", probe_text(F.col("props")).alias("probe"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n_tokens FROM documents")
def tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {_SHINGLES} SELECT id AS doc_id, len(s)::BIGINT AS n_shingles FROM s WHERE side = 'd'")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(shingles(tokens(F.col("text")), 3)).cast("long").alias("n_shingles"))


@query(r"SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))")
def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each normalised text; the text is hashed before it is shuffled."""
    key = F.sha2(collapsed(F.col("text")), 256)
    return table(spark, sf_dir, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_NEAR = rf"""
WITH {_SHINGLES},
x AS (SELECT d.lang, e.id, e.n, e.g FROM e JOIN documents d ON e.side = 'd' AND d.doc_id = e.id),
c AS (SELECT a.lang, a.id AS i, b.id AS j, a.n, b.n AS m, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.lang = b.lang AND a.id < b.id GROUP BY ALL),
p AS (SELECT lang, i, j, common / (n + m - common)::DOUBLE AS jaccard FROM c WHERE common / (n + m - common)::DOUBLE >= {NEAR})
"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    return sim.near_pairs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text"), NEAR)


@query(_NEAR + "SELECT lang, i, j, round(jaccard, 6) AS jaccard FROM p")
def neardup_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select(F.col("grp").alias("lang"), "i", "j", F.round("jaccard", 6).alias("jaccard"))


@query(
    _NEAR
    + """, s2 AS (SELECT lang, id, md5(string_agg(g, '|' ORDER BY g)) AS s FROM x GROUP BY lang, id), c2 AS (SELECT lang, s, min(id) AS rep, count(*) AS copies FROM s2 GROUP BY lang, s),
pr AS (SELECT p.i, p.j FROM p JOIN c2 a ON a.rep = p.i JOIN c2 b ON b.rep = p.j), ends AS (SELECT rep, count(*) AS n FROM (SELECT i AS rep FROM pr UNION ALL SELECT j FROM pr) GROUP BY rep)
SELECT c2.rep AS doc_id, copies::BIGINT AS copies, coalesce(ends.n, 0)::BIGINT AS near_classes FROM c2 LEFT JOIN ends USING (rep)"""
)
def neardup_minhash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal shingle sets, and how many others of the language each is near to: MinHash candidates, verified exactly."""
    members, pairs = sim.near_classes(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text"), NEAR)
    ends = pairs.select(F.explode_outer(F.array("i", "j")).alias("rep")).groupBy("rep").agg(F.count("*").alias("near_classes"))
    return members.groupBy("rep").agg(F.count("*").alias("copies")).join(ends, "rep", "left").select(F.col("rep").alias("doc_id"), "copies", F.coalesce("near_classes", F.lit(0)).alias("near_classes"))


@query(
    _NEAR.replace("WITH", "WITH RECURSIVE")
    + """, ord AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY id) AS k FROM (SELECT DISTINCT unnest([i, j]) AS id, lang FROM p)),
gr(lang, k, kept) AS (
  SELECT DISTINCT lang, 0::BIGINT, []::BIGINT[] FROM ord
  UNION ALL
  SELECT gr.lang, o.k, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.lang = gr.lang AND p.j = o.id AND list_contains(gr.kept, p.i)) THEN gr.kept ELSE list_append(gr.kept, o.id) END
  FROM gr JOIN ord o ON o.lang = gr.lang AND o.k = gr.k + 1
), f AS (SELECT lang, kept FROM gr QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC) = 1)
SELECT d.doc_id, (d.doc_id NOT IN (SELECT id FROM ord) OR coalesce(list_contains(f.kept, d.doc_id), false)) AS kept
FROM documents d LEFT JOIN f ON f.lang = d.lang"""
)
def minhash_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first near-duplicate removal within a language."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text")
    gone = sim.near_gone(docs, NEAR)
    return nodes.join(gone, "id", "left").select(F.col("id").alias("doc_id"), F.col("partner").isNull().alias("kept"))


#: Cosine of near texts, and of a text that repeats a probe (a long text and a short probe share little of the former).
COSINE = 0.9
PROBE_COSINE = 0.4

_VECTORS = r"""
wv AS (SELECT side, id, lang, list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: ('0x' || substr(md5('v|' || x), 1, 8))::BIGINT) AS h
       FROM (SELECT 'd' AS side, doc_id AS id, lang, text FROM documents UNION ALL SELECT 'p', item_id, NULL, text FROM benchmark)),
gv AS (SELECT side, id, lang, unnest(list_distinct(list_concat(list_transform(h, lambda x: (x * 7919 + 1) % 2147483647), list_transform(range(1, len(h)), lambda i: (h[i] * 1000003 + h[i + 1]) % 2147483647)))) AS g FROM wv),
cv AS (SELECT side, id, lang, g % 128 AS d, sum(1 - 2 * (g // 128 % 2)) AS x FROM gv GROUP BY ALL),
iv AS (SELECT side, id, lang FROM cv GROUP BY ALL HAVING max(abs(x)) > 0),
vec AS (SELECT iv.side, iv.id, iv.lang, list(coalesce(cv.x, 0)::DOUBLE ORDER BY r.d) AS v FROM iv CROSS JOIN range(128) r(d) LEFT JOIN cv ON cv.side = iv.side AND cv.id = iv.id AND cv.d = r.d GROUP BY ALL)
"""
_PAIRS = f"""{_VECTORS},
p AS (SELECT a.lang, a.id AS i, b.id AS j, a.v = b.v AS same, list_cosine_similarity(a.v, b.v) AS cosine
      FROM vec a JOIN vec b ON a.side = 'd' AND b.side = 'd' AND a.lang IS NOT DISTINCT FROM b.lang AND a.id < b.id
      WHERE list_cosine_similarity(a.v, b.v) >= {COSINE} - 1e-12)
"""


@query(
    f"""WITH {_SHINGLES}, {_VECTORS}, c AS (SELECT d.id, p.id AS probe, round(list_cosine_similarity(d.v, p.v), 12) AS cosine FROM vec d JOIN vec p ON d.side = 'd' AND p.side = 'p'),
bc AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, probe) = 1)
SELECT r.doc_id, r.item_id, round(r.raw, 6) AS score, bc.probe AS near_item, round(coalesce(bc.cosine, 0), 6) AS cosine, r.raw >= {DROP} OR coalesce(bc.cosine, 0) >= {PROBE_COSINE} AS dropped
FROM r LEFT JOIN bc ON bc.id = r.doc_id"""
)
def decontam_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its nearest probes by shared shingles and by vectors; one of the two is enough to drop it."""
    found = vec.decontaminate(_queries(spark, sf_dir), _probes(spark, sf_dir), DROP, PROBE_COSINE)
    return found.select(F.col("id").alias("doc_id"), F.col("probe").alias("item_id"), F.round("score", 6).alias("score"), F.col("near").alias("near_item"), F.round("cosine", 6).alias("cosine"), "dropped")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vec.text_vectors(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), "text"))


@query(
    f"""WITH {_PAIRS}, m AS (SELECT id, min(id) OVER (PARTITION BY lang, v) AS rep, count(*) OVER (PARTITION BY lang, v) AS copies FROM vec WHERE side = 'd'),
reps AS (SELECT p.* FROM p WHERE i IN (SELECT rep FROM m) AND j IN (SELECT rep FROM m))
SELECT lang, i, j, round(cosine, 6) AS cosine FROM reps"""
)
def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of a language, between the first documents of each class of equal vectors; ``semantic_classes`` has the members."""
    pairs = vec.class_pairs(_vectors(spark, sf_dir), COSINE)
    return pairs.select(F.col("grp").alias("lang"), "i", "j", F.round("cosine", 6).alias("cosine"))


@query(
    f"""WITH {_PAIRS}, m AS (SELECT id, min(id) OVER (PARTITION BY lang, v) AS rep, count(*) OVER (PARTITION BY lang, v) AS copies FROM vec WHERE side = 'd'),
n AS (SELECT id, count(*) AS n FROM (SELECT i AS id FROM p UNION ALL SELECT j FROM p) GROUP BY id)
SELECT m.id AS doc_id, m.rep AS class_id, m.copies::BIGINT AS copies, coalesce(n.n, 0)::BIGINT AS n_links FROM m LEFT JOIN n USING (id)"""
)
def semantic_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with words: its class of equal vectors, and how many documents of its language are near it."""
    found = vec.class_links(_vectors(spark, sf_dir), COSINE)
    return found.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), "copies", "n_links")


@query(
    f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT id, lang, row_number() OVER (PARTITION BY lang ORDER BY id) AS k FROM (SELECT DISTINCT unnest([i, j]) AS id, lang FROM p)),
g(lang, k, kept) AS (
  SELECT DISTINCT lang, 0::BIGINT, []::BIGINT[] FROM o
  UNION ALL
  SELECT g.lang, o.k, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.j = o.id AND list_contains(g.kept, p.i)) THEN g.kept ELSE list_append(g.kept, o.id) END
  FROM g JOIN o ON o.lang = g.lang AND o.k = g.k + 1
), f AS (SELECT lang, kept FROM g QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC) = 1)
SELECT d.doc_id, (d.doc_id NOT IN (SELECT id FROM o) OR coalesce(list_contains(f.kept, d.doc_id), false)) AS kept FROM documents d LEFT JOIN f ON f.lang = d.lang"""
)
def semantic_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first removal of documents whose vectors are near, within a language."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    gone = vec.keep_first(_vectors(spark, sf_dir), COSINE)
    return nodes.join(gone, "id", "left").select(F.col("id").alias("doc_id"), F.col("partner").isNull().alias("kept"))


_SPLIT = "('0x' || substr(md5('leak|' || {0}), 1, 8))::BIGINT % 10"


@query(
    f"""WITH {_VECTORS}, h AS (SELECT id, v FROM vec WHERE side = 'd' AND {_SPLIT.format('id')} >= 8)
SELECT doc_id FROM documents WHERE {_SPLIT.format('doc_id')} < 8 AND doc_id NOT IN (SELECT a.id FROM vec a JOIN h ON a.side = 'd' AND list_cosine_similarity(a.v, h.v) >= {COSINE} - 1e-12)"""
)
def cross_split_leak_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train documents that resemble no validation or test document."""
    split = draw("leak", F.col("id")) % 10
    docs = _vectors(spark, sf_dir).select("id", "vector", (split >= 8).alias("held"))
    train = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).where(split < 8)
    return train.join(vec.near_held(docs, COSINE), "id", "left_anti").select(F.col("id").alias("doc_id"))
