"""The registered query of each operator, and its SQL where SQL can say it.

Each query applies its operator, with production parameters, to its whole
table and derives the columns of its result from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, decontaminate, filter_audit, htmltext, licenses, neardup, pii, secrets, spelling, topk, toxicity, urlfilter, warc
from .common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# --- 1: byte-level BPE --------------------------------------------------------

def bpe_ranks() -> tuple[bytes, str]:
    """The rank file and the pattern of the public tokenizer; its place is a
    parameter of the operator."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def bpe_digests(docs):
    ranks, pattern = bpe_ranks()
    both = bpe.decode(bpe.encode(docs, ranks, pattern, "doc_id", "text"), ranks)
    return both.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op1_byte_bpe")
def op1(spark, d):
    return bpe_digests(read(spark, d, "documents"))


# --- 2: secret scans ----------------------------------------------------------

def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secret_matches(kind: str, least: int) -> str:
    pattern, group = secrets.PATTERNS[kind]
    p = _sql_text(pattern)
    return f"""SELECT row, {secrets.KINDS.index(kind)} AS kind, e - length(m) AS first, e AS last, v AS value
      FROM (SELECT row, unnest(m) AS m, unnest(v) AS v,
                   unnest(list_transform(range(1, len(m) + 1), lambda i:
                       CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) AS BIGINT)
                       + CAST(list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT))) AS e
            FROM (SELECT row, string_split_regex(text, {p}) AS g, regexp_extract_all(text, {p}) AS m,
                         regexp_extract_all(text, {p}, {group}) AS v FROM d)) WHERE length(v) >= {least}"""


_SECRET_NAMES = "[" + ", ".join(map(_sql_text, secrets.KINDS)) + "]"


@register("op2_secrets", f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, source FROM documents),
c AS ({_secret_matches('assign', secrets.LEAST_ASSIGNED)} UNION ALL {_secret_matches('access', 1)} UNION ALL {_secret_matches('hex', 1)}),
o AS (SELECT value, count(DISTINCT owner) >= {secrets.EXAMPLE_OWNERS} OR count(DISTINCT owner || ':' || repo) >= {secrets.EXAMPLE_REPOS} AS copied
      FROM (SELECT value, coalesce(source, '') || ':' || (source IS NULL) AS owner, coalesce(CAST(doc_id AS VARCHAR), 'none') AS repo
            FROM c JOIN d USING (row)) GROUP BY value),
v AS (SELECT DISTINCT row, CASE WHEN copied THEN 4 ELSE 3 END AS kind, first, last
      FROM c JOIN o USING (value)
      WHERE copied
         OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
             AND NOT regexp_matches(value, {_sql_text(secrets._PLACEHOLDER)})
             AND len(list_distinct(string_split(value, ''))) >= {secrets.LIVE_CHARACTERS})),
b AS (SELECT row, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
             count(*) FILTER (WHERE kind = 2) AS n_hex,
             string_agg({_SECRET_NAMES}[kind + 1] || ':' || first || ':' || last, ',' ORDER BY first, kind) AS base
      FROM c GROUP BY row),
s AS (SELECT row, string_agg({_SECRET_NAMES}[kind + 1] || ':' || first || ':' || last, ',' ORDER BY first, kind) AS spans
      FROM (SELECT row, kind, first, last FROM c UNION ALL SELECT * FROM v) GROUP BY row)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b USING (row) LEFT JOIN s USING (row)""")
def op2(spark, d):
    found = secrets.scan(read(spark, d, "documents"), "text", "doc_id", "source", ["doc_id"])

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("keep.doc_id", *map(count, secrets.PATTERNS),
                        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


# --- 3: MinHash near-dedup ----------------------------------------------------

@register("op3_neardup", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
      WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
k AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(k.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""")
def op3(spark, d):
    found = neardup.near_duplicates(read(spark, d, "documents"), "doc_id", "text", shingle=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


# --- 4: WARC ------------------------------------------------------------------

@register("op4_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
g AS (SELECT html, max(page_id) AS first_id FROM p WHERE n >= {warc.LEAST_BYTES} GROUP BY html)
SELECT p.page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g ON p.n >= {warc.LEAST_BYTES} AND p.html = g.html""")
def op4(spark, d):
    path = scratch_path(spark, "archive")
    warc.write(read(spark, d, "pages"), path, "page_id", "url", "html")
    rows = warc.read(spark, path, payload=False)

    def page(record):
        number = F.substring(record, len(warc.record_id("")) + 1, 1 << 20)
        return F.when(number != "", number).cast("long")

    return rows.select(page(F.col("record")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       page(F.col("refers_to")).alias("refers_to"))


# --- 5: licence scans ---------------------------------------------------------

@register("op5_licenses")
def op5(spark, d):
    found = licenses.scan(read(spark, d, "documents"), "text", ["doc_id"])
    names = F.array_sort(F.array_distinct(F.col("base.label")))
    return found.select("keep.doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                        F.array_min("base.at").alias("first_word"), F.array_max("base.at").alias("last_word"),
                        F.array_join(names, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"),
                        F.round("score", 6).alias("score"))


# --- 6: benchmark decontamination ---------------------------------------------

def _word_list(text: str) -> str:
    """Words of the decontamination and licence contracts, in DuckDB."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def leaks(docs, benchmark):
    return decontaminate.find_leaks(docs, benchmark, "doc_id", "text", "item_id", "text")


@register("op6_decontaminate", f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_word_list('text')} AS w FROM benchmark
           WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item, len(list_slice(w, i, i + 9)) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase
       FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_word_list("coalesce(text, '')")} AS w FROM documents),
dw AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, n
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, bw.n, item FROM dw JOIN bw ON bw.phrase = dw.phrase AND bw.n = dw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op6(spark, d):
    found = leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


# --- 7: HTML extraction -------------------------------------------------------

@register("op7_html_text")
def op7(spark, d):
    found = htmltext.extract(read(spark, d, "pages"), "page_id", "html")
    return found.select(F.col("id").alias("page_id"), "text", F.length("text").cast("long").alias("n_chars"))


# --- 8: toxicity --------------------------------------------------------------

#: A document is rejected from this score on.
TOXIC_FROM = 0.3


def toxicity_model(docs, labels):
    return toxicity.train(*toxicity.sample(docs, labels, "doc_id", "text", "toxic"))


@register("op8_toxicity")
def op8(spark, d):
    docs = read(spark, d, "documents")
    model = toxicity_model(docs, read(spark, d, "labels"))
    scored = toxicity.score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


# --- 9: personal data ---------------------------------------------------------

@register("op9_pii")
def op9(spark, d):
    found = pii.find_pii(read(spark, d, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in pii.KINDS),
                        F.sha2("base", 256).alias("base_sha256"), "spans")


# --- 10: exact top-k search ---------------------------------------------------

@register("op10_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def op10(spark, d):
    e = read(spark, d, "embeddings")
    return topk.exact_topk(e, e["vec_id"] % 50 == 0, 5, "vec_id", "embedding")


# --- 11: filter interaction audit ---------------------------------------------

@register("op11_filter_audit", """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
             CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN coalesce(d.doc_id > first, false) THEN 'E' ELSE '' END AS fails
      FROM d JOIN f USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, good, bad, count(*) AS n FROM x GROUP BY ALL),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
o AS (SELECT a.s || b.s || c.s || d.s || e.s AS o FROM s a, s b, s c, s d, s e
      WHERE length(replace(replace(replace(replace(replace(a.s || b.s || c.s || d.s || e.s, 'A', ''), 'B', ''), 'C', ''), 'D', ''), 'E', '')) = 0
        AND len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
p AS (SELECT part, o AS filter_order, i AS step, n, good, bad, contains(fails, o[i]) AS hit, fails = o[i] AS alone, o[i] AS letter,
             len(list_filter(range(1, i), lambda j: contains(fails, o[j]))) = 0 AS there
      FROM c, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS i)),
r AS (SELECT part, filter_order, step, any_value(letter) AS letter,
             CAST(coalesce(sum(n) FILTER (there AND NOT hit), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (there AND hit), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (NOT there AND hit), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(n) FILTER (there AND hit AND good), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(n) FILTER (there AND hit AND bad), 0) AS BIGINT) AS toxic_lost
      FROM p GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r""")
def op11(spark, d):
    return filter_audit.filter_audit(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id", "text", "lang")


# --- 13: spelling variant grouping --------------------------------------------

@register("op13_spelling_variants", f"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END, CAST(i AS BIGINT))) AS crc),
r AS (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
      WHERE length(run) >= 5 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_transform(range(0, octet_length(encode(named))), lambda j:
          CAST(instr('0123456789ABCDEF', substr(hex(encode(named)), 2 * j + 1, 1)) * 16
               + instr('0123456789ABCDEF', substr(hex(encode(named)), 2 * j + 2, 1)) - 17 AS BIGINT)),
          lambda c, b: xor(crc[1 + (xor(c, b) & 255)], c >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) AS h
      FROM r, k),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n
      FROM (SELECT n, CASE WHEN h % {spelling.SPOILED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                           ELSE run END AS word FROM h)
      WHERE length(word) >= {spelling.LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
e AS (SELECT word, n, substr(word, 1, i) || '?' || substr(word, i + 2) AS swapped, substr(word, 1, i) || substr(word, i + 2) AS cut
      FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
x AS (SELECT DISTINCT e.word AS a, e.n AS an, v.word AS b, v.n AS bn FROM e JOIN v ON e.cut = v.word),
m AS (SELECT a.word, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.swapped = b.swapped AND a.word <> b.word
      UNION ALL SELECT a, b, bn FROM x UNION ALL SELECT b, a, an FROM x),
b AS (SELECT word, near AS form, near_n AS form_n, count(*) OVER (PARTITION BY word) AS n_near,
             row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM m),
f AS (SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form,
             CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word AND place = 1),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN c USING (word) JOIN f g ON g.word = c.at WHERE g.form IS NULL""")
def op13(spark, d):
    found = spelling.spelling_groups(read(spark, d, "documents"), "doc_id", "text")
    return found.select("word", "form", "root", "n", "n_near", "form_n")


# --- 12: URL filters ----------------------------------------------------------

def _rule_fits(part: str) -> str:
    """The longest rule's text or verdict, as a CASE over the rules."""
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if part == 'rule' else v}'"
        for h, p, v in sorted(urlfilter.RULES, key=lambda r: -len(r[0] + r[1])))
    return f"CASE {cases} END"


def _sql_grams(text: str, seed: int) -> str:
    h = str(seed)
    for j in range(urlfilter.GRAM):
        h = f"({h} * 131 + unicode({text}[i + {j}]))"
    return f"list_transform(range(1, length({text}) - {urlfilter.GRAM - 2}), lambda i: CAST({h} % {urlfilter.BUCKETS} AS INTEGER))"


def _sql_sum(values: str) -> str:
    return f"list_reduce({values}, lambda s, x: s + x, CAST(0 AS DOUBLE))"


_SQL_MARGIN = f"b + {_sql_sum('list_transform({0}.found, lambda k: w[k + 1])')} / {{0}}.size"


@register("op12_url_filters", f"""
WITH RECURSIVE u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT page_id, host, path, {_rule_fits('rule')} AS rule, {_rule_fits('verdict')} AS by_rule FROM u),
g AS (SELECT *, sqrt(CAST(greatest(len(found), 1) AS DOUBLE)) AS size
      FROM (SELECT host, path, list_sort(list_distinct({_sql_grams('h', urlfilter.SEEDS[0])} || {_sql_grams('p', urlfilter.SEEDS[1])})) AS found
            FROM (SELECT host, path, '^' || host || '$' AS h, path || '$' AS p FROM (SELECT DISTINCT host, path FROM r)))),
l AS (SELECT row_number() OVER (ORDER BY host, path) AS i, CASE WHEN by_rule = 'block' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y, found, size
      FROM (SELECT *, row_number() OVER (PARTITION BY by_rule ORDER BY md5(host || path), host, path) AS place
            FROM (SELECT DISTINCT host, path, by_rule FROM r WHERE by_rule IS NOT NULL)) JOIN g USING (host, path)
      WHERE place <= {urlfilter.LABELLED}),
e AS (SELECT list(coalesce(held, []) ORDER BY bucket) AS held
      FROM (SELECT unnest(range({urlfilter.BUCKETS})) AS bucket)
           LEFT JOIN (SELECT bucket, list(i ORDER BY i) AS held FROM (SELECT i, unnest(found) AS bucket FROM l) GROUP BY bucket) USING (bucket)),
t AS (SELECT rows, held, CAST(greatest(len(rows), 1) AS DOUBLE) AS n
      FROM (SELECT coalesce(list({{'y': y, 'found': found, 'size': size}} ORDER BY i), []) AS rows FROM l), e),
m AS (SELECT 0 AS step, list_transform(range({urlfilter.BUCKETS}), lambda k: CAST(0 AS DOUBLE)) AS w, CAST(0 AS DOUBLE) AS b
      UNION ALL
      SELECT step + 1,
             list_transform(range({urlfilter.BUCKETS}), lambda k: w[k + 1] - {urlfilter.RATE}::DOUBLE * (
                 {_sql_sum('list_transform(held[k + 1], lambda i: errors[i] / rows[i].size)')} / n + {urlfilter.SHRINK}::DOUBLE * w[k + 1])),
             b - {urlfilter.RATE}::DOUBLE * {_sql_sum('errors')} / n
      FROM (SELECT *, list_transform(rows, lambda r: 1.0::DOUBLE / (1.0::DOUBLE + exp(-({_SQL_MARGIN.format('r')}))) - r.y) AS errors FROM m, t)
      WHERE step < {urlfilter.STEPS}),
s AS (SELECT host, path, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({_SQL_MARGIN.format('g')}))) AS score FROM g, (SELECT w, b FROM m WHERE step = {urlfilter.STEPS}))
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score > {urlfilter.BLOCK_OVER}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
       round(score, 6) AS score
FROM r JOIN s USING (host, path)""")
def op12(spark, d):
    found = urlfilter.filter_urls(read(spark, d, "pages"), "url", ["page_id"])
    return found.select("keep.page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))
