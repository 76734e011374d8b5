"""Registered queries of the text operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ann,
    collocations,
    decontaminate,
    line_dedup,
    mixing,
    packing,
    secret_scan,
    sharding,
    simhash,
    spelling,
    substring_dedup,
    token_files,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(read(spark, sf_dir, "documents"))
    return token_files.read_token_files(spark, manifest, ids=False)


@register("op8_slots")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


@register("op2_mixture_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@register("op9_secrets")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    return found.select(
        "doc_id",
        *(count(r.kind) for r in secret_scan.BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@register("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_LOWER = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
MARKED_SQL = f"""WITH dw AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
  bw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS w FROM benchmark),
  phrases AS (
    SELECT DISTINCT item, LEAST(10, len(w)) AS n, array_to_string(w[k : k + LEAST(10, len(w)) - 1], ' ') AS g
    FROM bw, LATERAL (SELECT unnest(range(1, len(w) - LEAST(10, len(w)) + 2)) AS k) WHERE len(w) > 0),
  sizes AS (SELECT DISTINCT n FROM phrases),
  windows AS (
    SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
    FROM (SELECT * FROM dw, sizes), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
  hits AS (SELECT doc_id, k, windows.n, item FROM windows JOIN phrases ON windows.n = phrases.n AND windows.g = phrases.g),
  marked AS (
    SELECT doc_id, COUNT(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM hits) GROUP BY doc_id),
  items AS (
    SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items,
    sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
  FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)"""


@register("op7_decontamination", MARKED_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), items, keep_text=False)
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
    )


LINES_SQL = r"""WITH raw AS (
    SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS k,
      unnest(string_split(text, chr(10))) AS ln
    FROM documents WHERE text IS NOT NULL),
  lines AS (
    SELECT *, trim(ln, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM raw),
  numbered AS (
    SELECT doc_id, k, ln, core, SUM(CASE WHEN core <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS unit,
      MAX(k) OVER (PARTITION BY doc_id) AS last_k
    FROM lines),
  units AS (
    SELECT doc_id, unit, MAX(core) AS core,
      string_agg(ln || CASE WHEN k < last_k THEN chr(10) ELSE '' END, '' ORDER BY k) AS body
    FROM numbered GROUP BY doc_id, unit),
  windows AS (
    SELECT doc_id, unit, core, LEAD(core, 1) OVER w AS c1, LEAD(core, 2) OVER w AS c2,
      LEAD(unit, 1) OVER w AS u1, LEAD(unit, 2) OVER w AS u2
    FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
  ranked AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY core, c1, c2 ORDER BY doc_id, unit) AS nth
    FROM windows WHERE u2 IS NOT NULL),
  gone AS (
    SELECT DISTINCT doc_id, unnest([unit, u1, u2]) AS unit FROM ranked WHERE nth > 1),
  kept AS (
    SELECT u.doc_id, COUNT(*) AS n_lines, COUNT(g.unit) AS n_removed,
      string_agg(CASE WHEN g.unit IS NULL THEN u.body ELSE '' END, '' ORDER BY u.unit) AS body
    FROM units u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.unit = g.unit GROUP BY u.doc_id)
  SELECT d.doc_id, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed, 0) AS n_removed,
    CASE WHEN d.text IS NOT NULL THEN sha256(body) END AS text_sha256
  FROM documents d LEFT JOIN kept USING (doc_id)"""


@register("op3_line_winnowing", LINES_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


REPEATS_SQL = r"""WITH dw AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  windows AS (
    SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS g
    FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS k)),
  firsts AS (SELECT g, MIN(doc_id) AS first_id FROM windows GROUP BY g),
  gone AS (
    SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS place
    FROM windows JOIN firsts USING (g) WHERE first_id < doc_id),
  words AS (SELECT doc_id, generate_subscripts(w, 1) AS place, unnest(w) AS word FROM dw),
  kept AS (
    SELECT doc_id, COUNT(gone.place) AS n_removed,
      string_agg(CASE WHEN gone.place IS NULL THEN word END, ' ' ORDER BY words.place) AS kept
    FROM words LEFT JOIN gone USING (doc_id, place) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_removed, 0) AS n_removed,
    sha256(COALESCE(kept, '')) AS kept_sha256
  FROM dw LEFT JOIN kept USING (doc_id)"""


@register("op10_suffix_trees", REPEATS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


@register("op6_cross_polytope")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = toxicity.score_documents(docs.select("doc_id", "text"), labels)
    return found.select("doc_id", "held_out", F.col("toxicity").alias("score"), "predicted")


MIX_SQL = r"""WITH measured AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      md5(concat_ws(':', '0', COALESCE(CAST(doc_id AS VARCHAR), ''), md5(COALESCE(text, '')))) AS key
    FROM documents),
  sources AS (
    SELECT source, CAST(SUM(size) AS HUGEINT) AS s, 1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
    FROM measured GROUP BY source),
  sums AS (SELECT SUM(s) AS t FROM sources),
  ordered AS (
    SELECT *, COALESCE(SUM(3 * s) OVER (ORDER BY 3 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
      SUM(w) OVER (ORDER BY 3 * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS o
    FROM sources, sums),
  capped AS (SELECT *, c * w + 3 * s * o <= t * w AS is_full FROM ordered),
  rest AS (
    SELECT MAX(t) - COALESCE(SUM(CASE WHEN is_full THEN 3 * s END), 0) AS r,
      COALESCE(SUM(CASE WHEN NOT is_full THEN w END), 1) AS o
    FROM capped),
  plan AS (
    SELECT source, CAST(s AS BIGINT) AS source_size,
      CASE WHEN is_full THEN CAST(3 * s AS DOUBLE) ELSE CAST(w * rest.r AS DOUBLE) / CAST(rest.o AS DOUBLE) END AS target,
      CAST(CASE WHEN is_full THEN 3 * s ELSE (2 * w * rest.r + rest.o) // (2 * rest.o) END AS BIGINT) AS budget
    FROM capped, rest),
  placed AS (
    SELECT m.doc_id, m.size, p.*, COALESCE(SUM(m.size) OVER (
        PARTITION BY m.source ORDER BY m.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM measured m JOIN plan p ON m.source IS NOT DISTINCT FROM p.source)
  SELECT doc_id, size, source_size, target,
    CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
      + LEAST(GREATEST(budget % source_size - before, 0), size) END AS BIGINT) AS taken
  FROM placed"""


@register("op11_source_mixing", MIX_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


PHRASE_SQL = r"""WITH folded AS (
    SELECT doc_id, COALESCE(lang, 'und') AS lang,
      translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents),
  pieces AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM folded),
  split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  totals AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS total FROM split GROUP BY lang),
  grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g
    FROM (SELECT lang, w, k FROM split, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
      LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)),
  f AS (SELECT lang, k, g, COUNT(*) AS a FROM grams GROUP BY lang, k, g HAVING COUNT(*) >= 30),
  cuts AS (
    SELECT lang, k, g, a, j, array_to_string(string_split(g, ' ')[1 : j], ' ') AS g1,
      array_to_string(string_split(g, ' ')[j + 1 : k], ' ') AS g2
    FROM f, LATERAL (SELECT unnest(range(1, k)) AS j) WHERE k > 1),
  scored AS (
    SELECT c.lang, c.k, c.g, c.a, c.j, x.a AS l, y.a AS r,
      CAST((2000000 * CAST(c.a AS HUGEINT)) // (x.a + y.a) AS BIGINT) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.k = c.j AND x.g = c.g1
      JOIN f y ON y.lang = c.lang AND y.k = c.k - c.j AND y.g = c.g2),
  lowest AS (
    SELECT * FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, k, g ORDER BY score, j) = 1),
  extended AS (
    SELECT lang, array_to_string(string_split(g, ' ')[1 : k - 1], ' ') AS g, a FROM f WHERE k > 2
    UNION ALL SELECT lang, array_to_string(string_split(g, ' ')[2 : k], ' ') AS g, a FROM f WHERE k > 2),
  held AS (SELECT lang, g, MAX(a) AS most FROM extended GROUP BY lang, g),
  ranked AS (
    SELECT s.lang, ROW_NUMBER() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.g) AS rank,
      s.g AS phrase, s.a, s.l, s.r, s.score
    FROM lowest s LEFT JOIN held h ON s.lang = h.lang AND s.g = h.g
    WHERE h.most IS NULL OR 100 * h.most < 80 * s.a)
  SELECT lang, rank, phrase, a, l, r, total AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@register("op13_collocations", PHRASE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


VARIANT_SQL = r"""WITH bits AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
      lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc),
  runs AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, unnest(regexp_extract_all(
      translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
    FROM documents),
  counted AS (SELECT COALESCE(id, '') AS id, w, COUNT(*) AS n FROM runs GROUP BY ALL),
  bytes AS (
    SELECT w, n, flatten(list_transform(string_split(id || ':' || w, ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b
    FROM counted WHERE length(w) >= 7),
  hashed AS (
    SELECT w, n, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b),
      lambda h, x: xor(h >> 8, crc[1 + xor(h & 255, x)])), 4294967295) AS h
    FROM bytes, bits),
  kept AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n
    FROM hashed),
  words AS (
    SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING SUM(n) >= 2),
  holes AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d
    FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
  near AS (
    SELECT holes.word AS a, words.word AS b FROM holes JOIN words ON holes.d = words.word
    UNION SELECT words.word, holes.word FROM holes JOIN words ON holes.d = words.word
    UNION SELECT x.word, y.word FROM holes x JOIN holes y ON x.d = y.d AND x.i = y.i AND x.word <> y.word),
  best AS (
    SELECT a, COUNT(*) AS n_near, arg_min(b, (-n, b)) AS b, MAX(n) AS b_n FROM near JOIN words ON b = word GROUP BY a),
  formed AS (
    SELECT word, n, COALESCE(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * n THEN b END AS form,
      CASE WHEN b_n >= 10 * n THEN b_n END AS form_n
    FROM words LEFT JOIN best ON word = a),
  chain AS (
    WITH RECURSIVE c AS (
      SELECT word, word AS root, form AS next FROM formed
      UNION ALL SELECT c.word, c.next, f.form FROM c JOIN formed f ON f.word = c.next)
    SELECT word, root FROM c WHERE next IS NULL)
  SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)"""


@register("op12_spelling", VARIANT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))
