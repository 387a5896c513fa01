"""Thin queries ``opN_<name>`` over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import LOWER, UPPER, crc_mod, table

#: Vocabulary of op7: a file of the installed public tokenizers.
BPE_FILE = "word_bpe_49k.json"
#: Model of op11, likewise.
PIECE_FILE = "piece_bpe_32k.model"
#: Key of the pseudonyms; a deployment passes its own.
PII_KEY = "corpus-pseudonyms-1"


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BPE_FILE)


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_FILE)


def op1_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.learned_partitions import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.ngram_join import link_classes

    return link_classes(table(spark, sf_dir, "documents"), k=4, threshold=85).select("doc_id", "n_shingles", "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm import secrets

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digests(secrets.scan(docs, secrets.fit(docs)))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.mixing import mix

    rows, plan = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    weight = F.lit(0.0)
    for source, w in plan.weights.items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(w)).otherwise(weight)
    return rows.select(
        "doc_id", "source", F.col("__tokens").alias("n_tokens"), F.col("__epoch").alias("epoch"), F.col("__order").alias("block_order"),
        weight.alias("weight"), F.lit(plan.exponent).alias("exponent"),
    )


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.pii import replace_pii

    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, count_col="n_replaced")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), bpe_path())


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.cap_filters import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.pitman_yor import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.url_reputation import judge, outcomes_from_labels

    verdicts = judge(table(spark, sf_dir, "pages").select("page_id", "url"), outcomes_from_labels(table(spark, sf_dir, "labels")))
    return verdicts.select("page_id", "host", "path", "rule", "verdict")


def op11_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.piece_bpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), piece_path())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.spelling import variants

    return variants(table(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5, noise=199)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"), min_docs=30, add=5, scale=1_000_000_000, top_terms=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_learned_partitions, op2_ngram_jaccard, op3_secret_scan, op4_temperature_mixing, op5_pii_pseudonyms,
        op6_toxicity, op7_rank_array_bpe, op8_cap_filters, op9_pitman_yor, op10_url_reputation,
        op11_offset_pieces, op12_spelling_variants, op13_source_divergence,
    )
}

_CLASSES = """
, reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
, class AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
"""

_OP2 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
, shingles AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                          ELSE [array_to_string(w, ' ')] END) AS sh FROM words WHERE len(w) > 0))
, sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id)
, common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM shingles x JOIN shingles y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY ALL)
, links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * m >= 85 * (s.n + t.n - m))
{_CLASSES}
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN class c ON c.a = d.doc_id
"""

_OP8 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0)
, links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= 0.98)
{_CLASSES}
, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN class c ON c.a = e.vec_id LEFT JOIN degree g ON g.a = e.vec_id
"""


def _strength_sql(groups: str) -> str:
    """Strength of a level's beta prior, as url_reputation computes it."""
    return f"""(SELECT CASE WHEN n = 0 OR n IS NULL OR g < 2 OR m * (1 - m) <= 0 OR n - n2 / n - (g - 1) <= 0 THEN 10.0
      WHEN ((s - n * m * m) / (m * (1 - m)) - (g - 1)) <= 0 THEN 1e5
      ELSE least(1e5, greatest(0.5, (n - n2 / n - (g - 1)) / ((s - n * m * m) / (m * (1 - m)) - (g - 1)) - 1)) END
      FROM (SELECT sum(n)::DOUBLE AS n, sum(bad)::DOUBLE / nullif(sum(n), 0) AS m, count(*)::DOUBLE AS g, sum(n * n)::DOUBLE AS n2, sum(bad * bad / n::DOUBLE) AS s
            FROM {groups} WHERE n > 0))"""


def _op10() -> str:
    from ledgerfold.llm.url_reputation import RULES, TWO_LABEL_SUFFIXES

    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    wide = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
, u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut)
, outcome AS (
  SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id)
, host AS (SELECT host, sum(coalesce(n, 0)) AS n, sum(coalesce(bad, 0)) AS bad, string_split(host, '.') AS part FROM u LEFT JOIN outcome USING (page_id) GROUP BY host)
, placed AS (
  SELECT *, array_to_string(part[greatest(1, len(part) - 1):], '.') IN ({wide}) AS wide FROM host)
, h AS (
  SELECT host, n, bad, array_to_string(part[greatest(1, len(part) - CASE WHEN wide THEN 2 ELSE 1 END):], '.') AS domain,
         CASE WHEN wide THEN array_to_string(part[greatest(1, len(part) - 1):], '.') ELSE part[-1] END AS suffix FROM placed)
, d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL)
, s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL)
, k AS (SELECT {_strength_sql('h')} AS kh, {_strength_sql('d')} AS kd, {_strength_sql('s')} AS ks, (SELECT (coalesce(sum(bad), 0) + 0.2) / (coalesce(sum(n), 0) + 2.0) FROM s) AS root)
, rate AS (
  SELECT h.host, h.n + kh AS w, (h.bad + kh * (d.bad + kd * (s.bad + ks * root) / (s.n + ks)) / (d.n + kd)) / (h.n + kh) AS m
  FROM h JOIN d USING (domain, suffix) JOIN s USING (suffix), k)
, rule AS (SELECT * FROM (VALUES {rules}) AS t(action, rhost, rpath))
, fit AS (
  SELECT page_id, rhost || rpath AS rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC) AS place
  FROM u JOIN rule ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.action, CASE WHEN m - 1.64 * sqrt(m * (1 - m) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit f ON f.page_id = u.page_id AND f.place = 1 LEFT JOIN rate r ON r.host = u.host
"""


def _crc_nibbles() -> list[int]:
    """crc32 of the 16 half bytes, by the reflected polynomial."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


# The crc goes over half bytes, the lower one first; near words share a deletion.
_OP12 = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), '{UPPER}', '{LOWER}') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL)
, coded AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs)
, crc AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(len(hx)), lambda i: (instr('0123456789ABCDEF', hx[xor(i, 1) + 1]) - 1)::BIGINT)),
    lambda c, x: xor(({_crc_nibbles()}::BIGINT[])[1 + (xor(c, x) & 15)], c >> 4))) AS h FROM coded)
, counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n FROM crc GROUP BY 1)
, words AS (SELECT word, CAST(n AS BIGINT) AS n, length(word) AS len FROM counted WHERE length(word) >= 6 AND n >= 5)
, cut AS (
  SELECT word, n, len, unnest(list_transform(range(1, len + 1), lambda i: {{'at': i, 'rest': substr(word, 1, i - 1) || substr(word, i + 1)}}), recursive := true) FROM words)
, near AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.at = b.at AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word)
, ranked AS (SELECT word, near, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM near)
, led AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1)
, follow AS (SELECT word, word AS at FROM led UNION ALL SELECT f.word, l.form FROM follow f JOIN led l ON l.word = f.at WHERE l.form IS NOT NULL)
, root AS (SELECT f.word, f.at AS root FROM follow f JOIN led l ON l.word = f.at WHERE l.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM led JOIN root USING (word)
"""

_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)
, w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d)
, c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL)
, kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 30)
, l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang)
, g AS (SELECT DISTINCT lang, source FROM d)
, cell AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS ln FROM g JOIN kept k USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term)
, total AS (SELECT lang, source, sum(n) AS total FROM cell GROUP BY ALL)
, p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (t.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (ln + 5)) // (l.total + 5 * l.v) AS q
  FROM cell JOIN total t USING (lang, source) JOIN l USING (lang))
, far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
, pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.f, 0) AS f FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source)
, every AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, item) AS rank FROM pair
  UNION ALL
  SELECT * FROM (
    SELECT lang, source, 'term' AS part, term AS item, p - q AS f, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM p WHERE n > 0 AND p > q)
  WHERE rank <= 50)
SELECT lang, source, part, item, CAST(f AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM every
"""

ORACLES: dict[str, str] = {"op12_spelling_variants": _OP12, "op13_source_divergence": _OP13, "op2_ngram_jaccard": _OP2, "op8_cap_filters": _OP8, "op10_url_reputation": _op10()}
