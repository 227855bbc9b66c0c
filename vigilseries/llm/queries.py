"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilseries.llm import ann, chat, exact, html, lm, mixing, near, packing, phrases, pii, quality, repeats, urls
from vigilseries.llm.text import WORD, let, word_array, whole

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

EXACT_SQL = rf"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


@register("op1_exact_dedup", EXACT_SQL)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.classes(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def _rule_sql(rule: quality.Rule) -> str:
    total = "1" if rule.total == "one" else rule.total
    bounds = []
    if rule.low is not None:
        bounds.append(f"100 * {rule.part} >= {rule.low} * {total}")
    if rule.high is not None:
        bounds.append(f"100 * {rule.part} <= {rule.high} * {total}")
    return f"((n_words < {rule.from_words}) OR ({' AND '.join(bounds)}))"


QUALITY_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{WORDS}')) AS lines
  FROM documents
), g AS (
  SELECT *, CASE WHEN len(words) < {quality.WINDOW} THEN []
    ELSE list_transform(range(1, len(words) - {quality.WINDOW - 2}),
                        lambda i: array_to_string(words[i:i + 4], ' ')) END AS grams
  FROM w
), again AS (
  SELECT doc_id, count(DISTINCT spot + k) AS n_repeat_words
  FROM (
    SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, gram) AS times
    FROM (SELECT doc_id, unnest(grams) AS gram, unnest(range(len(grams))) AS spot FROM g)
  ), range({quality.WINDOW}) AS r(k)
  WHERE times > 1 GROUP BY doc_id
), m AS (
  SELECT g.doc_id, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: list_contains({quality.STOP_FORMS!r}, x))) AS n_stop_words,
         length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_capitals,
         coalesce(list_sum(list_transform(range(0, len(words), {quality.BLOCK}),
             lambda i: len(list_distinct(words[i + 1:i + {quality.BLOCK}])))), 0)::BIGINT AS n_distinct_words
  FROM g LEFT JOIN again USING (doc_id)
), j AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(_rule_sql(r) for r in quality.RULES)} AS kept
FROM j
"""


@register("op2_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


@register("op3_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

URL_SQL = rf"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
u AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), d AS (SELECT DISTINCT host, path FROM u),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM d JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM u LEFT JOIN best USING (host, path)
"""


@register("op6_url_filters", URL_SQL)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, urls.rule_table(spark, URL_RULES)).select(
        F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict"
    )


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op7_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed(packing.pieces(read(spark, sf_dir, "documents"), byte_bpe()))
    return placed.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        "sequence_id", "offset",
    )


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS text,
         coalesce(floor(turn / {chat.BLOCK_TURNS}), -1)::BIGINT AS block
  FROM conversations
), s AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
p AS (
  SELECT t.conv_id, perspective, block, turn, who, text, who = perspective AS own,
         CASE WHEN who = perspective THEN '{chat.OPEN}assistant' || chr(10)
              WHEN who = 'system' THEN '{chat.OPEN}system' || chr(10)
              ELSE '{chat.OPEN}user name=' || who || chr(10) END AS head,
         '<|im_end|>' || chr(10) AS tail
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(text) + length(tail)) OVER w, 0)::BIGINT
              + length(head) AS start,
         row_number() OVER (PARTITION BY conv_id, perspective, block ORDER BY turn, who, text) AS k
  FROM p
  WINDOW w AS (PARTITION BY conv_id, perspective, block ORDER BY turn, who, text
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
)
SELECT conv_id, perspective, block, string_agg(head || text || tail, '' ORDER BY k) AS text,
       coalesce(string_agg(start || ':' || (start + length(text)), ',' ORDER BY k)
                FILTER (own), '') AS masks,
       count(*) AS n_turns, coalesce(sum(length(text)) FILTER (own), 0)::BIGINT AS n_masked
FROM o GROUP BY conv_id, perspective, block
"""


@register("op4_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(read(spark, sf_dir, "conversations"))


@register("op9_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(read(spark, sf_dir, "pages")).select(
        F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text",
        F.length("text").cast("long").alias("n_chars"),
    )


@register("op5_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(read(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[pii.number(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"),
        pii.joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )


@register("op8_minhash_near_dedup")
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near.classes(read(spark, sf_dir, "documents"), words=4, similarity=80)
    return found.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


@register("op10_lm_scoring")
def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


PHRASES_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2),
                                        lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 5) AS r(k) WHERE len(words) >= k
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND a >= 30),
s AS (
  SELECT DISTINCT c.lang, phrase, a AS beyond, array_to_string(words[i:i + m - 1], ' ') AS part
  FROM c, range(2, 4) AS r(m), range(1, 4) AS q(i) WHERE m < k AND i + m - 1 <= k
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM s WHERE s.lang = c.lang AND s.part = c.phrase AND 100 * s.beyond >= 80 * c.a)
), cuts AS (
  SELECT kept.lang, kept.phrase, kept.a, t.cut, x.a AS l, y.a AS r,
         (2000000::HUGEINT * kept.a // (x.a + y.a))::BIGINT AS score
  FROM kept JOIN range(1, 4) AS t(cut) ON cut < kept.k
  JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(words[1:cut], ' ')
  JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')
), low AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM low JOIN n USING (lang) QUALIFY rank <= 2000
"""


@register("op11_phrase_collocations", PHRASES_SQL)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(read(spark, sf_dir, "documents"))


# Checksum of the decimal identifier, as zlib computes it.
CRC_SQL = """
xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)
"""

RUNS_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws, {CRC_SQL} AS h
  FROM documents
), s AS (
  SELECT k, doc_id, ws, len(ws)::BIGINT AS n, coalesce(h % 10 = 0, false) AND len(ws) > 0 AS planted,
         (h // 10) % greatest(len(ws), 1) AS a, 1 + (len(ws) - (h // 10) % greatest(len(ws), 1)) // (3 + (h // 10) % 8) AS p
  FROM d
), w AS (
  SELECT k, n, unnest(range(n)) AS i,
         unnest(CASE WHEN planted THEN list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1])
                ELSE ws END) AS word
  FROM s
), grams AS (  -- a run of 24 words or more agrees with itself, one period on, for 16
  SELECT k, n, i, word, hash(list(word) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS g FROM w
), near AS (
  SELECT DISTINCT x.k, y.i - x.i AS q FROM grams x JOIN grams y ON x.k = y.k AND x.g = y.g AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
  WHERE x.i + 16 <= x.n AND y.i + 16 <= y.n
), e AS (
  SELECT x.k, q, x.i, x.i - row_number() OVER (PARTITION BY x.k, q ORDER BY x.i) AS island
  FROM near JOIN w x ON x.k = near.k JOIN w y ON y.k = x.k AND y.i = x.i + q AND x.word = y.word
), f AS (
  SELECT k, min(i) AS start, count(*) + q AS length, q FROM e GROUP BY k, q, island
  HAVING count(*) + q >= greatest(24, 3 * q)
), r AS (SELECT k, start, length, min(q) AS period FROM f GROUP BY k, start, length),
marks AS (SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN marks USING (k, i) GROUP BY k
), per AS (
  SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed
  FROM r GROUP BY k
), best AS (
  SELECT * FROM r x WHERE NOT EXISTS (
    SELECT 1 FROM r y WHERE y.k = x.k AND (y.length * x.period > x.length * y.period OR (
      y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM s LEFT JOIN per USING (k) LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text; where the identifier's checksum says so, its end repeats the words of a period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = (h - h % 10) / 10

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n.cast("long"))
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        told = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.array_join(told, " ")

    planted = (h % 10 == 0) & F.rlike(whole(text), F.lit(WORD))
    return F.when(planted, let(word_array(text), repeated)).otherwise(text)


@register("op12_periodic_runs", RUNS_SQL)
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text")
    )
    found = repeats.periodic(docs).withColumn("best", repeats.greatest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@register("op13_nearest_vectors")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
