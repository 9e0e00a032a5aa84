"""Registered queries over the test tables, each with its DuckDB oracle.

Every query reads whole tables (or data Spark derives from them); the
oracle is an independent SQL statement over the same parquet files.
Integer outputs are BIGINT/INTEGER on both sides and doubles are rounded
to 6 places, so value hashes compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import oracle as O
from .. import schema
from ..functions import html as H
from ..functions import text as X
from ..operators import clean as C
from ..operators import dedup as D
from ..operators import predicates as P
from ..operators import shape as S
from ..sources import pages as PG
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# --- cleaning ---------------------------------------------------------------

@register("clean_text", f"""
WITH {O.clean_text_ctes('documents', 'doc_id', 'text', 'text_clean')}
SELECT doc_id, text_clean FROM _c""")
def clean_text(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", H.clean_text(X.null_to_empty("text")).alias("text_clean"))


@register("clean_html", f"""
WITH {O.clean_text_ctes('pages', 'page_id', 'html', 'text_clean')}
SELECT page_id, text_clean FROM _c""")
def clean_html(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", H.clean_text(X.null_to_empty("html")).alias("text_clean"))


# Keyword field derived from ``part``: null for small parts, a plain string
# (the brand) for medium ones, an empty JSON list for the largest and a
# JSON list of the name's words otherwise.
def _raw_keywords(p):
    return (F.when(F.col("p_size") < 10, F.lit(None).cast("string"))
            .when(F.col("p_size") < 20, F.col("p_brand"))
            .when(F.col("p_size") >= 49, F.to_json(F.array().cast("array<string>")))
            .otherwise(F.to_json(F.split("p_name", " "))))


@register("keywords_join", """
SELECT p_partkey,
       CASE WHEN p_size < 10 THEN '' WHEN p_size < 20 THEN p_brand
            WHEN p_size >= 49 THEN '' ELSE replace(p_name, ' ', ', ') END AS mots_cles
FROM part""")
def keywords_join(spark, d):
    part = table(spark, d, "part")
    return part.select("p_partkey", X.join_keywords(_raw_keywords(part)).alias("mots_cles"))


def _record_like_parts(part):
    """Six record text columns derived from ``part`` by value ranges, with
    nulls and blanks where a real record would have them."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    return part.select(
        "p_partkey",
        F.when(size > 5, F.col("p_name")).alias("titre"),
        F.when(size > 5, F.col("p_brand")).alias("description"),
        F.when(size > 25, F.col("p_type")).otherwise(F.lit("")).alias("description_complete"),
        F.when(price >= 950, F.col("p_name")).alias("mots_cles"),
        F.lit(None).cast("string").alias("lieu"),
        F.lit("  ").alias("ville"))


_PARTS_SQL = """SELECT p_partkey,
  CASE WHEN p_size > 5 THEN p_name END AS titre,
  CASE WHEN p_size > 5 THEN p_brand END AS description,
  CASE WHEN p_size > 25 THEN p_type ELSE '' END AS description_complete,
  CASE WHEN p_retailprice >= 950 THEN p_name END AS mots_cles,
  CAST(NULL AS VARCHAR) AS lieu, '  ' AS ville FROM part"""


@register("concat_nonempty", f"""
WITH src AS ({_PARTS_SQL}),
long AS (UNPIVOT src ON titre, description, description_complete, mots_cles, lieu, ville
         INTO NAME col VALUE v),
{O.clean_text_ctes('long', 'p_partkey', 'v', 'clean', extra='col')}
SELECT p_partkey,
       string_agg(clean, ' . ' ORDER BY CASE col WHEN 'titre' THEN 1 WHEN 'description' THEN 2
            WHEN 'description_complete' THEN 3 WHEN 'mots_cles' THEN 4 WHEN 'lieu' THEN 5 ELSE 6 END)
         AS texte_complet
FROM _c WHERE clean <> '' GROUP BY p_partkey""")
def concat_nonempty(spark, d):
    rec = _record_like_parts(table(spark, d, "part"))
    return C.clean_records(rec, keyword_column=None).select("p_partkey", schema.COMBINED_TEXT)


# --- shape ------------------------------------------------------------------

DOCUMENT_COLUMNS = [("doc_id", "id"), ("title", "titre"), ("text", "texte"),
                    ("lang", "langue"), ("source", "source"), ("n_chars", "longueur")]


@register("shape_columns", """
SELECT doc_id AS id, text AS texte, lang AS langue, source, n_chars AS longueur
FROM documents""")
def shape_columns(spark, d):
    return S.project_known(table(spark, d, "documents"), DOCUMENT_COLUMNS)


# --- filter and dedup -------------------------------------------------------

@register("min_chars", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM documents
WHERE length(text) >= 200""")
def min_chars(spark, d):
    docs = table(spark, d, "documents")
    return (D.filter_min_chars(docs, "text", 200)
            .select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")))


@register("dedup_exact", f"""
SELECT min(doc_id) AS doc_id FROM documents GROUP BY {O.fingerprint_text('text')}""")
def dedup_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return D.dedup_first(docs, "text", "doc_id", keep=["doc_id"])


@register("filter_and_dedup", f"""
WITH {O.clean_text_ctes('documents', 'doc_id', 'text', 'clean')},
f AS (SELECT doc_id, clean FROM _c WHERE length(clean) >= 200)
SELECT min(doc_id) AS doc_id, sha256(arg_min(clean, doc_id)) AS text_sha256
FROM f GROUP BY {O.fingerprint_text('clean')}""")
def filter_and_dedup(spark, d):
    docs = table(spark, d, "documents")
    cleaned = docs.select("doc_id", H.clean_text(X.null_to_empty("text")).alias(schema.COMBINED_TEXT))
    kept = D.filter_and_dedup(cleaned, schema.COMBINED_TEXT, "doc_id", 200, squashed=True)
    return kept.select("doc_id", F.sha2(schema.COMBINED_TEXT, 256).alias("text_sha256"))


# --- ingest -----------------------------------------------------------------

@register("ingest_window", """
SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM events
WHERE ts >= DATE '2024-01-10' AND ts <= DATE '2024-01-20' AND event_type = 'click'""")
def ingest_window(spark, d):
    ev = table(spark, d, "events")
    out = P.window_filter(ev, "ts", "event_type", "click", as_of="2024-01-15", days=5)
    return out.select("event_id", "user_id", "event_type", "value",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


# --- landed pages (S1-S4, O2, U1) ------------------------------------------

_EVENT_FIELDS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
# A page fails to land when it holds an outlier value (a failed fetch).
_OUTLIER = 400.0
# In the streaming query, so that several do.
_STREAM_OUTLIER = 300.0


def _land_event_pages(spark, d, with_failures: bool) -> str:
    """Pack ``events`` into pages of 100 per region (event_type) and land
    them as JSON Lines under the shared scratch folder; pages holding an
    outlier value are truncated when ``with_failures``."""
    from ..session import scratch_path
    ev = table(spark, d, "events")
    packed = PG.pack_pages(ev, "event_type", "event_id", _EVENT_FIELDS)
    if with_failures:
        vals = F.from_json(F.get_json_object("value", "$.results[*].value"), "array<double>")
        bad = F.exists(vals, lambda v: v > F.lit(_OUTLIER))
        packed = packed.withColumn(
            "value", F.when(bad, F.substring("value", 1, F.floor(F.length("value") / 2).cast("int")))
            .otherwise(F.col("value")))
    path = scratch_path(spark, "landed-events")
    packed.select("value").write.mode("overwrite").text(path)
    return path


def _event_record():
    from pyspark.sql import types as T
    return T.StructType([T.StructField("event_id", T.LongType()),
                        T.StructField("ts", T.TimestampNTZType()),
                        T.StructField("user_id", T.LongType()),
                        T.StructField("event_type", T.StringType()),
                        T.StructField("value", T.DoubleType()),
                        T.StructField("props", T.StringType())])


def _read_event_pages(spark, path):
    return PG.read_landed_pages(spark, path, _event_record())


_PAGES_SQL = """pg AS (SELECT event_type, event_id // 100 AS page, max(value) AS vmax FROM events GROUP BY ALL),
bad AS (SELECT event_type, min(page) AS first_bad FROM pg WHERE vmax > 400 GROUP BY ALL)"""


@register("ingest_pages", """
SELECT event_id, event_type AS region, (event_id // 100) * 100 AS page_offset,
       CAST(row_number() OVER (PARTITION BY event_type, event_id // 100 ORDER BY event_id) - 1 AS BIGINT) AS pos,
       user_id, value, props, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM events""")
def ingest_pages(spark, d):
    pages = _read_event_pages(spark, _land_event_pages(spark, d, False))
    rec = PG.explode_records(pages)
    return rec.select("event_id", "region", "page_offset", "pos", "user_id", "value", "props",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("ingest_completeness", f"""
WITH {_PAGES_SQL},
per AS (SELECT e.event_type, count(*) AS expected,
               count(*) FILTER (WHERE b.page IS NULL) AS actual
        FROM events e LEFT JOIN (SELECT event_type, page FROM pg WHERE vmax > 400) b
          ON b.event_type = e.event_type AND b.page = e.event_id // 100
        GROUP BY ALL),
np AS (SELECT event_type, count(*) AS pages, count(*) FILTER (WHERE vmax > 400) AS bad_pages FROM pg GROUP BY ALL)
SELECT per.event_type AS region, CAST(expected AS BIGINT) AS expected, CAST(actual AS BIGINT) AS actual,
       CAST(pages AS BIGINT) AS pages, CAST(bad_pages AS BIGINT) AS bad_pages,
       (bad_pages = 0 AND actual >= expected) AS complete
FROM per JOIN np USING (event_type)""")
def ingest_completeness(spark, d):
    pages = _read_event_pages(spark, _land_event_pages(spark, d, True))
    return PG.completeness(pages).select("region", "expected", "actual", "pages", "bad_pages", "complete")


@register("ingest_prefix", f"""
WITH {_PAGES_SQL}
SELECT e.event_id, e.event_type AS region, (e.event_id // 100) * 100 AS page_offset
FROM events e LEFT JOIN bad b USING (event_type)
WHERE b.first_bad IS NULL OR e.event_id // 100 < b.first_bad""")
def ingest_prefix(spark, d):
    pages = _read_event_pages(spark, _land_event_pages(spark, d, True))
    rec = PG.explode_records(PG.readable_prefix(pages))
    return rec.select("event_id", "region", "page_offset")


@register("ingest_pruned", """
SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts
FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-15' - INTERVAL 20 DAY AND ts <= TIMESTAMP '2024-01-15' + INTERVAL 20 DAY""")
def ingest_pruned(spark, d):
    """P1 over records landed by region and month: the window's folders are
    the only ones read."""
    from ..session import scratch_path
    path = scratch_path(spark, "landed-by-month")
    PG.land_records(table(spark, d, "events"), path, "event_type", "ts")
    out = PG.read_window(spark, path, "event_type", "ts", "click", as_of="2024-01-15", days=20)
    return out.select("event_id", "user_id", "event_type", "value",
                      F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@register("ingest_stream", f"""
WITH pg AS (SELECT event_type, page, n, vmax > {_STREAM_OUTLIER} AND page % 2 = 1 AS bad
            FROM (SELECT event_type, event_id // 100 AS page, count(*) AS n, max(value) AS vmax FROM events GROUP BY ALL)),
r AS (SELECT event_type, min(page) FILTER (WHERE bad) AS first_bad, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS bad_pages,
             CAST(sum(n) AS BIGINT) AS expected, CAST(coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS BIGINT) AS actual FROM pg GROUP BY ALL)
SELECT e.event_id, e.event_type AS region, (e.event_id // 100) * 100 AS page_offset, pages, bad_pages, expected, actual,
       bad_pages = 0 AND actual >= expected AS complete
FROM events e JOIN r USING (event_type) WHERE first_bad IS NULL OR e.event_id // 100 < first_bad""")
def ingest_stream(spark, d):
    """S2/S3 over pages that land in three waves: pages with an outlier land
    broken first, every second of them good later; a part of the first wave
    lands again with the last. The records each source may keep, once each,
    with what is known of its completeness."""
    from ..session import scratch_path
    from ..streaming import landing as L
    packed = PG.pack_pages(table(spark, d, "events"), "event_type", "event_id", _EVENT_FIELDS)
    vals = F.from_json(F.get_json_object("value", "$.results[*].value"), "array<double>")
    odd = F.exists(vals, lambda v: v > F.lit(_STREAM_OUTLIER))
    page = F.floor(F.col("offset") / 100)
    waves = packed.select("value", "offset", page.alias("page"), odd.alias("odd"))
    broken = F.substring("value", 1, F.floor(F.length("value") / 2).cast("int"))
    land, out, done = (scratch_path(spark, f"stream-{x}") for x in ("landing", "out", "checkpoint"))
    first = waves.filter((F.col("page") % 3 == 0) | F.col("odd")).select(F.when(F.col("odd"), broken).otherwise(F.col("value")).alias("value"))
    second = waves.filter((F.col("page") % 3 == 1) & ~F.col("odd")).select("value")
    late = waves.filter((~F.col("odd") & ((F.col("page") % 3 == 2) | (F.col("page") % 6 == 0))) | (F.col("odd") & (F.col("page") % 2 == 0))).select("value")
    for wave in (first, second, late):
        wave.write.mode("append").text(land)
        query = L.ingest_pages_stream(spark, land, out, done, record_schema=_event_record())
        query.awaitTermination()
    state = L.landed_completeness(spark, out)
    return (L.landed_records(spark, out).select("event_id", "region", "page_offset")
            .join(state, "region").select("event_id", "region", "page_offset", "pages", "bad_pages", "expected", "actual", "complete"))


# --- retrieval over the embeddings table (J2, O1, W3, T16) -----------------
# Questions are every embedding row, searched against every embedding row.

from ..operators import context as CX  # noqa: E402
from ..operators import knn as KNN  # noqa: E402
from ..operators import metrics as M  # noqa: E402
from ..plans import evaluate as EV  # noqa: E402
from ..functions import prompt as PRM  # noqa: E402


def _emb_hits(spark, d, k, carry=(), **knn_args):
    e = table(spark, d, "embeddings")
    qs = e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    idx = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"),
                   *[F.col(c) for c in carry if c not in ("vector",)])
    return KNN.knn(qs, idx, k, carry=list(carry), **knn_args)


def _other_hits(spark, d, k, carry=()):
    """The k nearest vectors besides the question's own, which would be its
    own best hit and make every metric look better."""
    h = _emb_hits(spark, d, k + 1, carry).filter(F.col("question_id") != F.col("chunk_id"))
    w = Window.partitionBy("question_id").orderBy("rank")
    return h.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _sq(a, b):
    return (f"list_sum(list_transform(list_zip({a}, {b}), lambda x: "
            f"(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))")


def _dot(a, b):
    return (f"list_sum(list_transform(list_zip({a}, {b}), lambda x: "
            f"CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))")


def _hits_sql(k, others=False):
    but_itself = "WHERE q.vec_id <> v.vec_id" if others else ""
    return f"""hits AS (
  SELECT question_id, chunk_id, distance, rank FROM (
    SELECT q.vec_id AS question_id, v.vec_id AS chunk_id, {_sq('q.embedding', 'v.embedding')} AS distance,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {_sq('q.embedding', 'v.embedding')}, v.vec_id) AS rank
    FROM embeddings q CROSS JOIN embeddings v {but_itself}) WHERE rank <= {k})"""


def _knn_query(k):
    def run(spark, d):
        h = _emb_hits(spark, d, k)
        return h.select("question_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))
    return run


for _k in (3, 5):
    register(f"knn_top{_k}", f"""
WITH {_hits_sql(_k)}
SELECT question_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(distance, 6) AS distance FROM hits""")(
        _knn_query(_k))


@register("knn_grid", f"""
WITH {_hits_sql(3)}
SELECT question_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(distance, 6) AS distance FROM hits""")
def knn_grid(spark, d):
    """J2 beyond the broadcast bound: every embedding asks, in four blocks
    of questions that pass over the index one after the other."""
    some = table(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    h = _emb_hits(spark, d, 3, broadcast_max_bytes=-(-some["n"] // 4) * some["dim"] * 4)
    return h.select("question_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"))


def _docs_meta(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("titre"),
        F.col("lang").alias("ville"), "text")


@register("search_display", f"""
WITH {_hits_sql(3)}
SELECT h.question_id, CAST(h.rank AS INTEGER) AS rank, printf('%.2f', 1.0 - h.distance) AS relevance,
       coalesce(d.source, 'N/A') AS title, coalesce(d.lang, 'N/A') AS city,
       substr(d.text, 1, 200) || '...' AS preview
FROM hits h LEFT JOIN documents d ON d.doc_id = h.chunk_id""")
def search_display(spark, d):
    hits = _emb_hits(spark, d, 3).join(_docs_meta(spark, d), "chunk_id", "left")
    return CX.display_hits(hits)


@register("context_assembly", f"""
WITH {_hits_sql(3)}
SELECT h.question_id, CAST(count(*) AS INTEGER) AS n_contexts,
       string_agg(d.text, chr(10) || chr(10) ORDER BY h.rank) AS context
FROM hits h LEFT JOIN documents d ON d.doc_id = h.chunk_id GROUP BY h.question_id""")
def context_assembly(spark, d):
    hits = _emb_hits(spark, d, 3).join(_docs_meta(spark, d), "chunk_id", "left")
    return CX.assemble_context(hits)


def _emb_questions(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("question_id"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"),
                                               F.col("text").alias("question"))
    return e.join(docs, "question_id")


def _prompt_sql(context: str, question: str) -> str:
    slot = {"context": context, "question": question}
    return " || ".join(f"coalesce({slot[p]}, '')" if i % 2 else O.q(p) for i, p in enumerate(PRM.parts()))


@register("prompt_render", f"""
WITH {_hits_sql(3)},
ctx AS (SELECT h.question_id, string_agg(d.text, chr(10) || chr(10) ORDER BY h.rank) AS context
        FROM hits h LEFT JOIN documents d ON d.doc_id = h.chunk_id GROUP BY h.question_id)
SELECT e.vec_id AS question_id,
       {_prompt_sql("ctx.context", "qd.text")} AS prompt
FROM embeddings e JOIN documents qd ON qd.doc_id = e.vec_id
LEFT JOIN ctx ON ctx.question_id = e.vec_id""")
def prompt_render(spark, d):
    hits = _emb_hits(spark, d, 3).join(_docs_meta(spark, d), "chunk_id", "left")
    ctx = CX.assemble_context(hits)
    return CX.render_prompts(_emb_questions(spark, d), ctx).select("question_id", "prompt")


@register("eval_dataset", f"""
WITH {_hits_sql(5)}
SELECT e.vec_id AS question_id, qd.text AS question, CASE WHEN e.vec_id % 3 <> 0 THEN substr(qd.text, 1, 80) END AS answer,
       coalesce((SELECT list(d.text ORDER BY h.rank) FROM hits h JOIN documents d ON d.doc_id = h.chunk_id
                 WHERE h.question_id = e.vec_id), []) AS contexts,
       (SELECT qd.lang || ' ' || max(CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END) FROM labels l WHERE l.doc_id = e.vec_id) AS ground_truth
FROM embeddings e JOIN documents qd ON qd.doc_id = e.vec_id""")
def eval_dataset(spark, d):
    """Answers of two thirds of the questions, and ground truths from
    the labels, meet the questions and their contexts by key."""
    hits = _emb_hits(spark, d, 5).join(_docs_meta(spark, d), "chunk_id")
    qs = _emb_questions(spark, d)
    answers = qs.filter("question_id % 3 <> 0").select("question_id", F.substring("question", 1, 80).alias("answer"))
    lang = table(spark, d, "documents").select("doc_id", "lang")
    mark = F.when(F.col("quality") == 1, "good").otherwise("poor")
    truths = (table(spark, d, "labels").groupBy("doc_id").agg(F.max(mark).alias("mark")).join(lang, "doc_id")
              .select(F.col("doc_id").alias("question_id"), F.concat_ws(" ", "lang", "mark").alias("ground_truth")))
    return EV.eval_dataset(qs, hits, answers, truths)


# --- quality metrics (A5-A10, W4, T15, T17) --------------------------------

def _label_verdicts(spark, d):
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "source")
    return (lab.join(docs, "doc_id")
            .select(F.col("source").alias("question_id"), F.col("doc_id").alias("claim_no"),
                    F.col("quality").alias("supported"),
                    (F.lit(1) - F.col("toxic")).alias("attributed")))


@register("metric_faithfulness", """
SELECT d.source AS question_id, round(avg(CAST(l.quality AS DOUBLE)), 6) AS faithfulness
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source""")
def metric_faithfulness(spark, d):
    f = M.faithfulness(_label_verdicts(spark, d))
    return f.select("question_id", F.round("faithfulness", 6).alias("faithfulness"))


@register("metric_context_recall", """
SELECT d.source AS question_id, round(avg(CAST(1 - l.toxic AS DOUBLE)), 6) AS context_recall
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source""")
def metric_context_recall(spark, d):
    r = M.context_recall(_label_verdicts(spark, d))
    return r.select("question_id", F.round("context_recall", 6).alias("context_recall"))


def _judged_hits(spark, d, k=5, hits=None):
    e = table(spark, d, "embeddings")
    hits = _other_hits(spark, d, k) if hits is None else hits
    lq = e.select(F.col("vec_id").alias("question_id"), F.col("label").alias("lq"))
    lv = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("lv"))
    return (hits.join(lq, "question_id").join(lv, "chunk_id")
            .withColumn("relevant", (F.col("lq") == F.col("lv")).cast("int")))


_PRECISION_SQL = f"""{_hits_sql(5, others=True)},
j AS (SELECT h.question_id, h.rank, CASE WHEN lq.label = lv.label THEN 1.0 ELSE 0.0 END AS rel
      FROM hits h JOIN embeddings lq ON lq.vec_id = h.question_id JOIN embeddings lv ON lv.vec_id = h.chunk_id),
p AS (SELECT *, sum(rel) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / rank AS prec FROM j),
cp AS (SELECT question_id, sum(prec * rel) / greatest(sum(rel), 1.0) AS context_precision FROM p GROUP BY question_id)"""


@register("metric_context_precision", f"""
WITH {_PRECISION_SQL}
SELECT question_id, round(context_precision, 6) AS context_precision FROM cp""")
def metric_context_precision(spark, d):
    cp = M.context_precision(_judged_hits(spark, d))
    return cp.select("question_id", F.round("context_precision", 6).alias("context_precision"))


_RELEVANCY_SQL = f"""{_hits_sql(3, others=True)},
ar AS (SELECT h.question_id,
              avg({_dot('q.embedding', 'v.embedding')} /
                  (sqrt({_dot('q.embedding', 'q.embedding')}) * sqrt({_dot('v.embedding', 'v.embedding')}))) AS answer_relevancy
       FROM hits h JOIN embeddings q ON q.vec_id = h.question_id JOIN embeddings v ON v.vec_id = h.chunk_id
       GROUP BY h.question_id)"""


def _relevancy(spark, d, hits=None):
    """A8 with the 3 nearest vectors as the generated questions; ``hits``
    (with vectors, k >= 3) can be shared with another metric."""
    e = table(spark, d, "embeddings")
    hits = _other_hits(spark, d, 3, carry=["vector"]) if hits is None else hits
    gen = hits.filter(F.col("rank") <= 3).select(
        "question_id", F.col("rank").alias("gen_no"), "vector")
    qv = e.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_vector"))
    return M.answer_relevancy(gen, qv)


@register("metric_answer_relevancy", f"""
WITH {_RELEVANCY_SQL}
SELECT question_id, round(answer_relevancy, 6) AS answer_relevancy FROM ar""")
def metric_answer_relevancy(spark, d):
    return _relevancy(spark, d).select("question_id",
                                       F.round("answer_relevancy", 6).alias("answer_relevancy"))


@register("metric_gate", f"""
WITH {_PRECISION_SQL}, {_RELEVANCY_SQL.replace(_hits_sql(3, others=True), 'hits3 AS (SELECT * FROM hits WHERE rank <= 3)').replace('FROM hits h', 'FROM hits3 h')},
f AS (SELECT avg(CAST(l.quality AS DOUBLE)) AS v FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source),
r AS (SELECT avg(CAST(1 - l.toxic AS DOUBLE)) AS v FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source),
means AS (
  SELECT 'faithfulness' AS metric, avg(v) AS mean FROM f
  UNION ALL SELECT 'context_recall', avg(v) FROM r
  UNION ALL SELECT 'context_precision', avg(context_precision) FROM cp
  UNION ALL SELECT 'answer_relevancy', avg(answer_relevancy) FROM ar)
SELECT metric, round(mean, 6) AS mean,
       CASE metric WHEN 'faithfulness' THEN CAST(0.8 AS DOUBLE)
                   WHEN 'context_precision' THEN CAST(0.5 AS DOUBLE) END AS threshold,
       CASE WHEN metric IN ('faithfulness', 'context_precision')
            THEN coalesce(mean >= CASE metric WHEN 'faithfulness' THEN 0.8 ELSE 0.5 END, false) END AS passed
FROM means""")
def metric_gate(spark, d):
    # One search serves both ranked metrics: the top 3 is a prefix of the
    # top 5. The hits (k rows per question) are written once to the shared
    # checkpoint folder, so the index is scanned once.
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    hits5 = _other_hits(spark, d, 5, carry=["vector"]).checkpoint(eager=True)
    parts = [
        M.metric_means(M.faithfulness(_label_verdicts(spark, d)), ["faithfulness"]),
        M.metric_means(M.context_recall(_label_verdicts(spark, d)), ["context_recall"]),
        M.metric_means(M.context_precision(_judged_hits(spark, d, hits=hits5)), ["context_precision"]),
        M.metric_means(_relevancy(spark, d, hits=hits5), ["answer_relevancy"]),
    ]
    means = parts[0]
    for p in parts[1:]:
        means = means.unionByName(p)
    gate = M.quality_gate(means)
    return gate.select("metric", F.round("mean", 6).alias("mean"), "threshold", "passed")


# --- chunking (T9, T10, W2, U3, P6, P7) ------------------------------------

from ..functions.embedder import FailingEmbedder, HashingEmbedder  # noqa: E402
from ..operators import chunk as CH  # noqa: E402
from ..operators import embed as EMB  # noqa: E402
from ..sources import index_store as IX  # noqa: E402

DOCS_SOURCE = "documents"


def documents_as_records(docs):
    """Map ``documents`` onto the record model: the text is the long
    description, the source is kept as the url, ``doc_id`` is the id and
    the order key."""
    return docs.select(F.col("doc_id").cast("string").alias("id"),
                       F.col("text").alias("description_complete"),
                       F.col("source").alias("url"),
                       F.col("doc_id").alias("_ord"))


def _collapsed_docs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("_ord"),
                       F.col("source").alias("url"), X.squash_spaces("text").alias("text"))


@register("chunk_all", f"""
WITH src AS (SELECT doc_id, {O.squash_spaces('text')} AS t FROM documents),
{O.splitter_chunks_sql('src', 1000, 100)}
SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(chunk_no AS VARCHAR) AS chunk_id, doc_id, chunk_no, text
FROM chunks""")
def chunk_all(spark, d):
    """Whitespace-collapsed documents split at 1000/100; the oracle is the
    same splitter written as a recursive SQL query."""
    ch = CH.chunk_records(_collapsed_docs(spark, d), "text", "id", "_ord", 1000, 100,
                          DOCS_SOURCE)
    return ch.select("chunk_id", F.col("_ord").alias("doc_id"), "chunk_no", "text")


_META = [c for c in schema.METADATA_COLUMNS if c not in ("id", "url")]


@register("chunk_metadata", f"""
WITH src AS (SELECT doc_id, {O.squash_spaces('text')} AS t FROM documents),
{O.splitter_chunks_sql('src', 1000, 100)}
SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(chunk_no AS VARCHAR) AS chunk_id, CAST(doc_id AS VARCHAR) AS id,
       d.source AS url, 'documents' AS source, chunk_no,
       {", ".join(f"d.lang || '{c}' || CAST(doc_id % {i + 2} AS VARCHAR) AS {c}" for i, c in enumerate(_META))}
FROM chunks JOIN documents d USING (doc_id)""")
def chunk_metadata(spark, d):
    """Every chunk with every metadata column (derived from the row)."""
    docs = _collapsed_docs(spark, d)
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("_ord"), "lang")
    docs = docs.join(lang, "_ord").select("*", *(
        F.concat("lang", F.lit(c), (F.col("_ord") % (i + 2)).cast("string")).alias(c) for i, c in enumerate(_META)))
    ch = CH.chunk_records(docs, "text", "id", "_ord", 1000, 100, DOCS_SOURCE)
    return ch.select("chunk_id", "id", "url", "source", "chunk_no", *_META)


# --- embedding, index (M1, U2, A1, A3, J1, J4, S5-S7) -----------------------

# Texts that the stand-in service refuses (a whole batch then fails).
REFUSED = r"(?i)\b(password|secret|api[ _-]?key)\b"


# Documents whose chunks form batches together, by their numbers.
EMBED_GROUP = 64


@register("embed_batches", f"""
WITH src AS (SELECT doc_id, {O.squash_spaces('text')} AS t FROM documents),
{O.splitter_chunks_sql('src', 1000, 100)},
b AS (SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(chunk_no AS VARCHAR) AS chunk_id, text, doc_id // {EMBED_GROUP} AS g,
             (row_number() OVER (PARTITION BY doc_id // {EMBED_GROUP} ORDER BY doc_id, chunk_no) - 1) // {schema.EMBED_BATCH_SIZE} AS slice
      FROM chunks),
bad AS (SELECT g, slice, bool_or(regexp_matches(text, {O.q(REFUSED)})) AS refused FROM b GROUP BY ALL),
{O.bow_vectors_sql('b', 'chunk_id', 'text', 64, 'cv')}
SELECT b.chunk_id, NOT refused AS has_vector,
       CASE WHEN refused THEN NULL ELSE round(list_sum(list_transform(cv.v, lambda x, i: CAST(x AS DOUBLE) * i)), 3) END AS weighted,
       CASE WHEN refused THEN 'RuntimeError: batch refused by the embedding service' END AS error
FROM b JOIN bad USING (g, slice) JOIN cv USING (chunk_id)""")
def embed_batches(spark, d):
    """M1 over all chunks, in batches of 50 formed by key; batches holding a
    refused text fail and their rows keep a null vector and an error."""
    ch = CH.chunk_records(_collapsed_docs(spark, d), "text", "id", "_ord", 1000, 100,
                          DOCS_SOURCE)
    emb = EMB.embed_batches(ch, FailingEmbedder(HashingEmbedder(64), REFUSED), "text",
                            batch_by=F.floor(F.col("_ord") / EMBED_GROUP), order_by=["_ord", "chunk_no"])
    weighted = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return emb.select("chunk_id", F.col("vector").isNotNull().alias("has_vector"),
                      F.round(weighted, 3).alias("weighted"), "error")


@register("index_complete", """
SELECT CAST(count(*) AS BIGINT) AS chunks, CAST(count(e.vec_id) AS BIGINT) AS with_vector,
       CAST(count(*) - count(e.vec_id) AS BIGINT) AS missing,
       (count(*) > 0 AND count(*) = count(e.vec_id)) AS complete
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.embedding IS NOT NULL""")
def index_complete(spark, d):
    """Documents as chunks, embeddings as their vectors."""
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"),
                                                F.col("embedding").alias("vector"))
    missing = IX.missing_vectors(chunks, vecs).select("chunk_id", F.lit(1).alias("_m"))
    j = chunks.join(missing, "chunk_id", "left")
    return j.agg(F.count(F.lit(1)).alias("chunks"),
                 F.count(F.when(F.col("_m").isNull(), 1)).alias("with_vector"),
                 F.count("_m").alias("missing")) \
        .withColumn("complete", (F.col("chunks") > 0) & (F.col("missing") == 0))


@register("index_roundtrip", """
SELECT vec_id AS chunk_id, label, CAST(len(embedding) AS INTEGER) AS dim,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm2
FROM embeddings""")
def index_roundtrip(spark, d):
    """S5 write a version, S6 read the published one back, J1 rows keyed."""
    from ..functions.vectors import dot
    from ..session import scratch_path
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"),
                                                F.col("embedding").alias("vector"), "label")
    path = scratch_path(spark, "index-roundtrip")
    rep = IX.publish(vecs, path, "testdata-embeddings", 64)
    if not rep.published:
        raise RuntimeError(f"index not published: {rep.reason}")
    idx = IX.load(spark, path, "testdata-embeddings", 64)
    return idx.select("chunk_id", "label", F.size("vector").cast("int").alias("dim"),
                      F.round(dot("vector", "vector"), 6).alias("norm2"))


# --- questions (P9) ---------------------------------------------------------

@register("questions_valid", """
SELECT conv_id, turn,
       CASE WHEN (conv_id + turn) % 7 IN (1, 3, 5) OR trim(text, ' ' || chr(9) || chr(10) || chr(160)) = ''
            THEN 400 ELSE 200 END AS status
FROM conversations WHERE role = 'user'""")
def questions_valid(spark, d):
    """The user turns, of which some are blanked in three ways (empty, white
    space, null) so that the rejecting branch runs."""
    conv = table(spark, d, "conversations").filter(F.col("role") == "user")
    by = (F.col("conv_id") + F.col("turn")) % 7
    conv = conv.withColumn("text", F.when(by == 1, "").when(by == 3, " \t\u00a0 ").when(by == 5, F.lit(None)).otherwise(F.col("text")))
    return P.with_status(conv, "text").select("conv_id", "turn", "status")


# The index the end-to-end queries build, restated in SQL: the document
# chunks (``ck``) of X1's text stages, their stand-in vectors (``cv``), the
# valid user turns (``qs``) with theirs (``qv``), and the exact top 3
# (``hits``) by squared L2 with ties broken by chunk id.
FLAGSHIP_DIM = 128
_DOC_CHUNKS_SQL = f"""{O.clean_text_ctes('documents', 'doc_id', 'text', 'clean')},
f AS (SELECT doc_id, clean FROM _c WHERE clean <> '' AND length(clean) >= 200),
keep AS (SELECT min(doc_id) AS doc_id FROM f GROUP BY {O.fingerprint_text('clean')}),
src AS (SELECT f.doc_id, f.clean AS t FROM f JOIN keep USING (doc_id)),
{O.splitter_chunks_sql('src', 1000, 100)},
ck AS (SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(chunk_no AS VARCHAR) AS chunk_id, doc_id, chunk_no, text
       FROM chunks)"""
def _search_sql(k: int) -> str:
    return f"""{_DOC_CHUNKS_SQL},
{O.bow_vectors_sql('ck', 'chunk_id', 'text', FLAGSHIP_DIM, 'cv')},
qs AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id, text AS question
       FROM conversations WHERE role = 'user' AND NOT (text IS NULL OR regexp_matches(text, {O.q(X.BLANK)}))),
{O.bow_vectors_sql('qs', 'question_id', 'question', FLAGSHIP_DIM, 'qv')},
hits AS (
  SELECT question_id, chunk_id, distance, rank FROM (
    SELECT question_id, chunk_id, distance,
           row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank
    FROM (SELECT q.question_id, c.chunk_id, {_sq('q.v', 'c.v')} AS distance FROM qv q CROSS JOIN cv c))
  WHERE rank <= {k})"""


_SEARCH_SQL = _search_sql(3)


# --- end to end (X1 + X3, X2) -----------------------------------------------

from ..functions import standins as ST  # noqa: E402


def _questions(spark, d):
    conv = table(spark, d, "conversations").filter(F.col("role") == "user")
    return conv.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"),
                       F.col("text").alias("question"))


def _built_index(spark, d, dim=FLAGSHIP_DIM):
    from ..plans.build import build_index
    from ..session import scratch_path
    emb = HashingEmbedder(dim)
    path = scratch_path(spark, "index")
    rep = build_index(documents_as_records(table(spark, d, "documents")), path, emb,
                      source=DOCS_SOURCE)
    if not rep.ok:
        raise RuntimeError(f"index build failed: {rep.reason}")
    return IX.load(spark, path, emb.name, emb.dim), emb


@register("index_and_search", f"""
WITH {_SEARCH_SQL}
SELECT h.question_id, CAST(h.rank AS INTEGER) AS rank, printf('%.2f', 1.0 - h.distance) AS relevance,
       'N/A' AS title, 'N/A' AS city, substr(c.text, 1, 200) || '...' AS preview, CAST(NULL AS VARCHAR) AS error
FROM hits h JOIN ck c USING (chunk_id)""")
def index_and_search(spark, d):
    """Flagship: build the index from ``documents`` (clean, filter, dedup,
    chunk, embed, verify, publish), then search it with every user turn of
    ``conversations`` (k = 3) and return the display rows."""
    from ..plans.serve import search
    idx, emb = _built_index(spark, d)
    return search(_questions(spark, d), idx, emb, 3)


@register("answer_prompts", f"""
WITH {_SEARCH_SQL},
ctx AS (SELECT h.question_id, count(*) AS n, string_agg(c.text, chr(10) || chr(10) ORDER BY h.rank) AS context
        FROM hits h JOIN ck c USING (chunk_id) GROUP BY h.question_id)
SELECT q.question_id, CAST(ctx.n AS INTEGER) AS n_contexts,
       sha256({_prompt_sql("ctx.context", "q.question")}) AS prompt_sha256
FROM qs q LEFT JOIN ctx USING (question_id)""")
def answer_prompts(spark, d):
    """X2 without a generator: every user turn gets its k = 3 context and
    prompt, compared by its digest."""
    from ..plans.serve import answer
    idx, emb = _built_index(spark, d)
    prompts, _ = answer(_questions(spark, d), idx, emb, 3)
    return prompts.select("question_id", "n_contexts", F.sha2("prompt", 256).alias("prompt_sha256"))


@register("answers_generated", f"""
WITH {_SEARCH_SQL},
ctx AS (SELECT h.question_id, string_agg(c.text, chr(10) || chr(10) ORDER BY h.rank) AS context
        FROM hits h JOIN ck c USING (chunk_id) GROUP BY h.question_id),
p AS (SELECT q.question_id, {_prompt_sql("ctx.context", "q.question")} AS prompt FROM qs q LEFT JOIN ctx USING (question_id))
SELECT question_id, {" || '. ' || ".join(f"substr(prompt, {a + 1}, {n})" for a, n in ST.QUOTED)} AS answer, CAST(NULL AS VARCHAR) AS answer_error,
       CAST(0 AS BIGINT) AS asked_again FROM p""")
def answers_generated(spark, d):
    """X2 with a generator (M3): every user turn is answered from its k = 3
    context, through the log of calls. The same questions asked again are
    answered from the log: ``asked_again`` counts the prompts that were sent a
    second time, to a model that refuses all."""
    from ..plans.serve import answer
    from ..session import scratch_path
    idx, emb = _built_index(spark, d)
    log, qs = scratch_path(spark, "answers-log"), _questions(spark, d)
    first, _ = answer(qs, idx, emb, 3, generate=ST.quote_prompts, log_path=log)
    again, _ = answer(qs, idx, emb, 3, generate=ST.refuse, log_path=log)
    sent = again.filter("answer_error is not null").count()
    return first.select("question_id", "answer", "answer_error", F.lit(sent).cast("long").alias("asked_again"))


@register("search_status", f"""
WITH a AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS question_id,
                  CASE WHEN (conv_id + turn) % 5 = 0 THEN ' ' WHEN conv_id % 97 = 0 THEN text || ' secret' ELSE text END AS question
           FROM conversations WHERE role = 'user'),
b AS (SELECT *, (row_number() OVER (ORDER BY question_id, question) - 1) // {schema.EMBED_BATCH_SIZE} AS slice
      FROM a WHERE trim(question) <> ''),
bad AS (SELECT slice, bool_or(regexp_matches(question, {O.q(REFUSED)})) AS refused FROM b GROUP BY slice)
SELECT question_id, CASE WHEN refused THEN 'failed' ELSE 'answered' END AS status,
       CASE WHEN refused THEN 'RuntimeError: batch refused by the embedding service' END AS error, CASE WHEN refused THEN 0 ELSE 3 END AS hits
FROM b JOIN bad USING (slice)
UNION ALL SELECT question_id, 'rejected', NULL, 0 FROM a WHERE trim(question) = ''""")
def search_status(spark, d):
    """What became of every question: some are blank, some are refused by the
    model with the batch they are in, the rest are answered (3 hits each)."""
    from ..plans.serve import find, question_status
    by = F.col("conv_id") + F.col("turn")
    asked = table(spark, d, "conversations").filter(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("question_id"),
        F.when(by % 5 == 0, " ").when(F.col("conv_id") % 97 == 0, F.concat("text", F.lit(" secret")))
        .otherwise(F.col("text")).alias("question"))
    e = table(spark, d, "embeddings")
    idx = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    valid, _ = P.split_questions(asked, "question")
    hits, failed = find(valid, idx, FailingEmbedder(HashingEmbedder(64), REFUSED), 3)
    n = hits.groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias("hits"))
    return (question_status(asked, failed).join(n, "question_id", "left")
            .select("question_id", "status", "error", F.coalesce("hits", F.lit(0)).alias("hits")))


@register("chunk_documents", f"""
WITH {_DOC_CHUNKS_SQL}
SELECT chunk_id, doc_id, chunk_no, text, 'documents' AS source FROM ck""")
def chunk_documents(spark, d):
    """The text stages of the index build (X1 before embedding) over all
    documents: clean (T1-T6, P4), length filter (P5), dedup keeping the
    first copy (D1/D2), chunk with metadata (T9/T10/P6/P7)."""
    from ..plans.build import chunks_from_records
    ch = chunks_from_records(documents_as_records(table(spark, d, "documents")), source=DOCS_SOURCE)
    return ch.select("chunk_id", F.col("_ord").alias("doc_id"), "chunk_no", "text", "source")


# --- evaluation job (X4) ----------------------------------------------------

from ..functions.embedder import TOKEN_CLASS  # noqa: E402


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), {O.q(TOKEN_CLASS)}), lambda w: length(w) >= {ST.LEAST_WORD})"


def _sql_claims(src: str, text: str) -> str:
    """Numbered claims of a text column: (question_id, known, c, w, no)."""
    return f"""SELECT question_id, known, c, w, row_number() OVER (PARTITION BY question_id ORDER BY i) AS no
      FROM (SELECT question_id, known, c, i, {_sql_words('c')} AS w
            FROM (SELECT question_id, known, unnest(pieces) AS c, unnest(range(1, len(pieces) + 1)) AS i
                  FROM (SELECT question_id, known, string_split({text}, '.') AS pieces FROM {src} WHERE {text} IS NOT NULL)))
      WHERE len(w) > 0"""


_QUOTED_SQL = " || '. ' || ".join(f"substr(prompt, {a + 1}, {n})" for a, n in ST.QUOTED)
_METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
_COSINE_SQL = f"{_dot('q.v', 'g.v')} / (sqrt({_dot('q.v', 'q.v')}) * sqrt({_dot('g.v', 'g.v')}))"


@register("evaluate_job", f"""
WITH {_search_sql(5)},
tr AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) AS question_id, max(text) AS truth
       FROM conversations WHERE role = 'assistant' GROUP BY ALL),
ctx AS (SELECT h.question_id, string_agg(c.text, chr(10) || chr(10) ORDER BY h.rank) AS context, list(c.text ORDER BY h.rank) AS contexts
        FROM hits h JOIN ck c USING (chunk_id) GROUP BY h.question_id),
p AS (SELECT q.question_id, q.question, {_prompt_sql("ctx.context", "q.question")} AS prompt, truth,
             flatten(list_transform(coalesce(contexts, []), lambda t: {_sql_words('t')})) AS known
      FROM qs q LEFT JOIN ctx USING (question_id) LEFT JOIN tr USING (question_id)),
an AS (SELECT *, {_QUOTED_SQL} AS answer FROM p),
cl AS ({_sql_claims('an', 'answer')}),
tc AS ({_sql_claims('an', 'truth')}),
fa AS (SELECT question_id, avg(CASE WHEN list_has_all(known, w) THEN 1.0 ELSE 0.0 END) AS faithfulness FROM cl GROUP BY question_id),
re AS (SELECT question_id, avg(CASE WHEN list_has_all(known, w) THEN 1.0 ELSE 0.0 END) AS context_recall FROM tc GROUP BY question_id),
j AS (SELECT h.question_id, h.rank, CASE WHEN list_has_any({_sql_words('q.question')}, {_sql_words('c.text')}) THEN 1.0 ELSE 0.0 END AS rel
      FROM hits h JOIN ck c USING (chunk_id) JOIN qs q USING (question_id)),
pr AS (SELECT *, sum(rel) OVER (PARTITION BY question_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / rank AS prec FROM j),
cp AS (SELECT question_id, sum(prec * rel) / greatest(sum(rel), 1.0) AS context_precision FROM pr GROUP BY question_id),
gq AS (SELECT question_id || ' ' || no AS gen, question_id, c AS text FROM cl WHERE no <= {ST.GENERATED}),
{O.bow_vectors_sql('gq', 'gen', 'text', FLAGSHIP_DIM, 'gv')},
ar AS (SELECT gq.question_id, avg(CASE WHEN {_dot('q.v', 'q.v')} > 0 AND {_dot('g.v', 'g.v')} > 0 THEN {_COSINE_SQL} END) AS answer_relevancy
       FROM gq JOIN gv g USING (gen) JOIN qv q USING (question_id) GROUP BY gq.question_id),
m AS (SELECT qs.question_id, faithfulness, answer_relevancy, context_precision, context_recall
      FROM qs LEFT JOIN fa USING (question_id) LEFT JOIN ar USING (question_id) LEFT JOIN cp USING (question_id) LEFT JOIN re USING (question_id)),
g AS ({" UNION ALL ".join(f"SELECT '{x}' AS name, avg({x}) AS mean, CAST({M.DEFAULT_GATES.get(x) or 'NULL'} AS DOUBLE) AS threshold FROM m" for x in _METRICS)}
      UNION ALL SELECT unnest(['failed_questions', 'failed_answers', 'failed_verdicts', 'failed_vectors']), 0.0, 0.0)
SELECT 'question' AS kind, question_id AS name, {", ".join(f"round({x}, 6) AS {x}" for x in _METRICS)},
       CAST(NULL AS VARCHAR) AS mean, CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS BOOLEAN) AS passed FROM m
UNION ALL SELECT 'gate', name, NULL, NULL, NULL, NULL, printf('%.2f', mean), threshold,
       CASE WHEN starts_with(name, 'failed') THEN true WHEN threshold IS NOT NULL THEN coalesce(mean >= threshold, false) END FROM g""")
def evaluate_job(spark, d):
    """X4 over the built index: every valid user turn is retrieved once
    (k = 5) and answered from those hits; the judge rates answers, ground
    truths (the assistant's turn after the question) and ranked contexts in
    batches; all four metrics of each question, and the gate's rows with
    their means to two decimals (T15)."""
    from ..plans.evaluate import evaluate
    idx, emb = _built_index(spark, d)
    conv = table(spark, d, "conversations").filter(F.col("role") == "assistant")
    truths = (conv.groupBy(F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("question_id"))
              .agg(F.max("text").alias("ground_truth")))
    _, per_q, gate, _ = evaluate(_questions(spark, d), idx, emb, k=5, generate=ST.quote_prompts, ground_truths=truths,
                                 judge_model=ST.LexicalJudge())
    rows = per_q.select(F.lit("question").alias("kind"), F.col("question_id").alias("name"), *(F.round(x, 6).alias(x) for x in _METRICS))
    report = M.gate_report(gate).select(F.lit("gate").alias("kind"), F.col("metric").alias("name"), "mean", "threshold", "passed")
    return rows.unionByName(report, allowMissingColumns=True)


# --- the whole build from landed pages (S1 S4 P1 P2 P3 X1), and rebuilds (X5 X6 P11 S7) ---

def _land_document_pages(spark, d) -> str:
    """``documents`` as landed pages of the source's records, with several
    text fields, a keyword list, dates and two regions."""
    from ..session import scratch_path
    docs = table(spark, d, "documents")
    region = F.when(F.col("doc_id") % 3 == 0, "Bretagne").otherwise(schema.DEFAULT_REGION)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int"))
    recs = docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("uid"), F.col("source").alias("title_fr"),
        F.col("text").alias("description_fr"), F.array("lang", "source").alias("keywords_fr"),
        F.date_format(day, "yyyy-MM-dd").alias(schema.DATE_FIELD), F.col("lang").alias("location_city"),
        region.alias(schema.REGION_FIELD))
    packed = PG.pack_pages(recs, schema.REGION_FIELD, "doc_id", [c for c in recs.columns if c != "doc_id"])
    path = scratch_path(spark, "landed-documents")
    packed.select("value").write.text(path)
    return path


_JOINED_ORDER = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(schema.JOINED_COLUMNS))


@register("build_from_pages", f"""
WITH r AS (SELECT doc_id, source AS titre, text AS description, lang || ', ' || source AS mots_cles, lang AS ville FROM documents
           WHERE doc_id % 3 <> 0 AND doc_id % 40 BETWEEN 4 AND 24),
long AS (UNPIVOT r ON titre, description, mots_cles, ville INTO NAME col VALUE v),
{O.clean_text_ctes('long', 'doc_id', 'v', 'clean', extra='col')},
comb AS (SELECT doc_id, string_agg(clean, '{schema.JOIN_SEPARATOR}' ORDER BY CASE col {_JOINED_ORDER} END) AS clean
         FROM _c WHERE clean <> '' GROUP BY doc_id),
f AS (SELECT * FROM comb WHERE length(clean) >= {schema.DEFAULT_MIN_CHARS}),
keep AS (SELECT min(doc_id) AS doc_id FROM f GROUP BY {O.fingerprint_text('clean')}),
src AS (SELECT f.doc_id, f.clean AS t FROM f JOIN keep USING (doc_id)),
{O.splitter_chunks_sql('src', schema.DEFAULT_CHUNK_SIZE, schema.DEFAULT_CHUNK_OVERLAP)}
SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(chunk_no AS VARCHAR) AS chunk_id, chunk_no, c.text, d.source AS titre,
       d.lang || ', ' || d.source AS mots_cles, d.lang AS ville,
       strftime(DATE '2024-01-01' + CAST(doc_id % 40 AS INTEGER), '%Y-%m-%d') AS date_debut, '{schema.DEFAULT_SOURCE}' AS source
FROM chunks c JOIN documents d USING (doc_id)""")
def build_from_pages(spark, d):
    """X1 end to end: landed pages, region and date window, shape, clean,
    filter, dedup, chunk, embed, verify, publish; the published rows."""
    from ..plans.build import build_index, prepare_records
    from ..session import scratch_path
    records = PG.explode_records(PG.readable_prefix(PG.read_landed_pages(spark, _land_document_pages(spark, d))))
    records = prepare_records(records.drop("region"), schema.DEFAULT_REGION, as_of="2024-01-15", days=10)
    emb, path = HashingEmbedder(32), scratch_path(spark, "index-from-pages")
    rep = build_index(records, path, emb)
    if not rep.ok:
        raise RuntimeError(f"index build failed: {rep.reason}")
    return IX.load(spark, path, emb.name, emb.dim).select(
        "chunk_id", "chunk_no", "text", "titre", "mots_cles", "ville", "date_debut", "source")


@register("rebuild_status", f"""
WITH {_DOC_CHUNKS_SQL}, n AS (SELECT (SELECT count(*) FROM documents) AS records, (SELECT count(*) FROM keep) AS kept, count(*) AS n FROM ck),
s(step, published, version, builds) AS (VALUES ('not ready', false, 0, 0), ('empty input', false, 0, 0), ('build', true, 1, 1),
  ('failed rebuild', false, 1, 2), ('rebuild', true, 2, 3), ('two at once', true, 4, 5), ('retired', true, 4, 1))
SELECT step, published, CAST(version AS BIGINT) AS version, CAST(CASE WHEN version > 0 THEN n ELSE 0 END AS BIGINT) AS vectors,
       CAST(builds AS BIGINT) AS builds, CAST(CASE WHEN version > 0 THEN records END AS BIGINT) AS records,
       CAST(CASE WHEN version > 0 THEN kept END AS BIGINT) AS deduplicated, CAST(CASE WHEN version > 0 THEN n END AS BIGINT) AS chunks
FROM s, n""")
def rebuild_status(spark, d):
    """What readers see after each step: nothing published yet, an empty
    input, a first build, a rebuild whose model refuses every batch, a rebuild
    that works, two at the same time, and the removal of all that is no longer
    named; with the stage counts (A1) of the version that is served."""
    from concurrent.futures import ThreadPoolExecutor

    from ..plans.build import rebuild_index
    from ..session import scratch_path
    path, emb = scratch_path(spark, "rebuilds"), HashingEmbedder(16)
    records = documents_as_records(table(spark, d, "documents"))

    def seen(step, ok):
        held = len(IX.builds(spark, path))
        try:
            now = IX.current(spark, path)
            counts = now["counts"]
            return (step, ok, int(now["version"]), IX.cardinality(IX.load(spark, path, emb.name, emb.dim)), held,
                    counts["input"], counts["deduplicated"], counts["chunks"])
        except IX.IndexNotFound:
            return step, ok, 0, 0, held, None, None, None

    rows = [seen("not ready", False)]
    for step, recs, model in (("empty input", records.limit(0), emb), ("build", records, emb),
                              ("failed rebuild", records, FailingEmbedder(emb, ".")), ("rebuild", records, emb)):
        rows.append(seen(step, rebuild_index(recs, path, model, source=DOCS_SOURCE).ok))
    with ThreadPoolExecutor(2) as pool:
        both = [pool.submit(rebuild_index, records, path, emb, source=DOCS_SOURCE) for _ in range(2)]
        rows.append(seen("two at once", all([b.result().ok for b in both])))
    IX.retire(spark, path, keep=1, min_age_s=0)
    rows.append(seen("retired", True))
    return spark.createDataFrame(rows, "step string, published boolean, version long, vectors long, builds long, "
                                       "records long, deduplicated long, chunks long")
