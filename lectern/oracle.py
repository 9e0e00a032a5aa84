"""DuckDB twins of the native text expressions.

Used only to build the independent SQL oracle in ``__spark_entry__`` and
in tests: the same regular expressions (written in the Java/RE2 common
subset) applied by a different engine.
"""

from __future__ import annotations

from .functions import html as H
from .functions import text as X


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re_replace(expr: str, pattern: str, repl: str = " ") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def strip_markup(expr: str) -> str:
    return re_replace(re_replace(re_replace(expr, H.COMMENT), H.RAW_TEXT_BLOCK), H.TAG)


def _entity_map_sql() -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in H._ENTITIES.items()) + "}"


def _code_to_text(n: str) -> str:
    return f"CASE WHEN {n} BETWEEN 1 AND 255 THEN chr(CAST({n} AS INTEGER)) ELSE ' ' END"


def _number_to_text(digits: str, base: int) -> str:
    s = f"ltrim({digits}, '0')"
    width = 3 if base == 10 else 2
    n = f"TRY_CAST({s} AS INTEGER)" if base == 10 else f"TRY_CAST('0x' || {s} AS INTEGER)"
    return (f"CASE WHEN {s} = '' THEN ' ' WHEN length({s}) > {width} THEN ' ' "
            f"ELSE ({_code_to_text(n)}) END")


def decode_references(expr: str) -> str:
    """Same rule as ``functions.html.decode_references``; ``expr`` should be
    a column name (it is repeated)."""
    name = f"regexp_extract(p, {q(H.NAME_HEAD)}, 1)"
    dec = f"regexp_extract(p, {q(H.DEC_HEAD)}, 1)"
    hexa = f"regexp_extract(p, {q(H.HEX_HEAD)}, 1)"
    parts = f"string_split({expr}, '&')"

    def after(n: str) -> str:
        return f"substr(p, {n} + 1)"

    def rest(a: str) -> str:
        return f"(CASE WHEN starts_with({a}, ';') THEN substr({a}, 2) ELSE {a} END)"

    def ended(a: str) -> str:
        return f"({a} <> '' OR i < len({parts}) - 1)"

    a_name, a_dec, a_hex = after(f"length({name})"), after(f"length({dec}) + 1"), after(f"length({hexa}) + 2")
    piece = (f"CASE WHEN {name} <> '' AND {ended(a_name)} "
             f"THEN coalesce(({_entity_map_sql()})[{name}], '&' || {name}) || {rest(a_name)} "
             f"WHEN {dec} <> '' AND {ended(a_dec)} AND NOT regexp_matches({a_dec}, '^[a-fA-F]') "
             f"THEN ({_number_to_text(dec, 10)}) || {rest(a_dec)} "
             f"WHEN {hexa} <> '' AND {ended(a_hex)} THEN ({_number_to_text(hexa, 16)}) || {rest(a_hex)} "
             f"ELSE '&' || p END")
    return (f"CASE WHEN strpos({expr}, '&') > 0 THEN ({parts})[1] || "
            f"array_to_string(list_transform(({parts})[2:], lambda p, i: {piece}), '') "
            f"ELSE {expr} END")


def keep_whitelist(expr: str) -> str:
    return re_replace(expr, X.NOT_KEPT)


def squash_spaces(expr: str) -> str:
    return f"trim({re_replace(expr, X.WS_RUN)}, ' ')"


def fingerprint_text(expr: str) -> str:
    return f"trim({re_replace(f'lower({expr})', X.WS_RUN)}, ' ')"


def after_markup(expr: str) -> str:
    """T4 + T5 applied to already decoded text."""
    return squash_spaces(keep_whitelist(expr))


def clean_text_ctes(table: str, key: str, col: str, out: str = "clean",
                    extra: str = "") -> str:
    """Two CTEs ``_m`` (markup stripped) and ``_c`` (fully cleaned) over
    ``table``; ``_c`` has ``key``, ``out`` and the ``extra`` columns."""
    ex = f", {extra}" if extra else ""
    return (f"_m AS (SELECT {key}{ex}, {strip_markup(f"coalesce(CAST({col} AS VARCHAR), '')")} AS m FROM {table}), "
            f"_d AS (SELECT {key}{ex}, {decode_references('m')} AS d FROM _m), "
            f"_c AS (SELECT {key}{ex}, {after_markup('d')} AS {out} FROM _d)")


def _pieces_sql(t: str, sep: str) -> str:
    """Pieces of ``t`` split at ``sep`` (a column), each separator kept at
    the start of the following piece, empty pieces dropped; '' -> chars."""
    return (f"CASE WHEN {sep} = '' THEN list_transform(range(1, length({t}) + 1), lambda i: substr({t}, i, 1)) "
            f"ELSE list_filter(list_transform(string_split({t}, {sep}), "
            f"lambda x, i: CASE WHEN i = 1 THEN x ELSE {sep} || x END), lambda x: x <> '') END")


def splitter_chunks_sql(src: str, size: int, overlap: int) -> str:
    """CTEs ending in ``chunks(doc_id, chunk_no, text)``: the recursive
    character splitter with separators '. ', ' ', '' (whitespace-collapsed
    text has no newlines) over ``src(doc_id, t)``.

    Pieces form a tree (a piece of ``size`` or more is split again with the
    next separators); runs of short sibling pieces are merge groups. Each
    group is merged by a recursive CTE that steps from one chunk to the
    next with prefix sums: the chunk starting at piece ``st`` ends at the
    last piece that keeps it within ``size``; the next chunk starts at the
    first piece whose suffix fits the overlap rule."""
    S, Ov = int(size), int(overlap)
    return f"""
s1 AS (SELECT doc_id, t, CASE WHEN strpos(t, '. ') > 0 THEN '. ' WHEN strpos(t, ' ') > 0 THEN ' ' ELSE '' END AS sep
       FROM {src} WHERE t <> ''),
l1x AS (SELECT doc_id, sep, {_pieces_sql('t', 'sep')} AS pl FROM s1),
l1 AS (SELECT doc_id, sep, unnest(pl) AS p, unnest(range(1, len(pl) + 1)) AS k FROM l1x),
l1g AS (SELECT *, length(p) >= {S} AS big,
               sum(CASE WHEN length(p) >= {S} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS nb FROM l1),
l2s AS (SELECT doc_id, k, p AS t, CASE WHEN sep = '. ' AND strpos(p, ' ') > 0 THEN ' ' ELSE '' END AS sep
        FROM l1g WHERE big),
l2x AS (SELECT doc_id, k, sep, {_pieces_sql('t', 'sep')} AS pl FROM l2s),
l2 AS (SELECT doc_id, k, sep, unnest(pl) AS p, unnest(range(1, len(pl) + 1)) AS j FROM l2x),
l2g AS (SELECT *, length(p) >= {S} AND sep <> '' AS big,
               sum(CASE WHEN length(p) >= {S} AND sep <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY j) AS nb FROM l2),
l3x AS (SELECT doc_id, k, j, {_pieces_sql('p', "''")} AS pl FROM l2g WHERE big),
l3 AS (SELECT doc_id, k, j, unnest(pl) AS p, unnest(range(1, len(pl) + 1)) AS c FROM l3x),
atoms AS (
  SELECT doc_id, '1:' || nb AS grp, k AS o1, 0 AS o2, 0 AS o3, p FROM l1g WHERE NOT big
  UNION ALL SELECT doc_id, '2:' || k || ':' || nb, k, j, 0, p FROM l2g WHERE NOT big
  UNION ALL SELECT doc_id, '3:' || k || ':' || j, k, j, c, p FROM l3),
grp AS (SELECT doc_id, grp, min([o1, o2, o3]) AS gord,
               list(p ORDER BY o1, o2, o3) AS pcs,
               list(CAST(length(p) AS BIGINT) ORDER BY o1, o2, o3) AS lens
        FROM atoms GROUP BY doc_id, grp),
grp2 AS (SELECT doc_id, grp, gord, pcs, len(pcs) AS n,
                [CAST(0 AS BIGINT)] || list_transform(range(1, len(lens) + 1), lambda i: list_sum(lens[1:i])) AS cb
         FROM grp),
chain AS (
  WITH RECURSIVE ch(doc_id, grp, step, st, en, n, cb, pcs) AS (
    SELECT doc_id, grp, 1, 1, len(list_filter(cb[2:], lambda x: x <= {S})), n, cb, pcs FROM grp2
    UNION ALL
    SELECT doc_id, grp, step + 1, st2,
           len(list_filter(cb[2:], lambda x: x <= cb[st2] + {S})), n, cb, pcs
    FROM (SELECT *, list_min(list_filter(range(st, en + 2), lambda q:
                NOT ((cb[en + 1] - cb[q]) > {Ov}
                     OR ((cb[en + 1] - cb[q]) + (cb[en + 2] - cb[en + 1]) > {S} AND (cb[en + 1] - cb[q]) > 0)))) AS st2
          FROM ch WHERE en < n))
  SELECT doc_id, grp, step, trim(array_to_string(pcs[st:en], ''), ' ') AS text FROM ch),
chunks AS (
  SELECT c.doc_id, CAST(row_number() OVER (PARTITION BY c.doc_id ORDER BY g.gord, c.step) - 1 AS BIGINT) AS chunk_no,
         c.text
  FROM chain c JOIN grp2 g USING (doc_id, grp) WHERE c.text <> '')"""


def bow_vectors_sql(src: str, key: str, text: str, dim: int, out: str) -> str:
    """CTEs ending in ``{out}({key}, v FLOAT[dim])``: the stand-in
    ``HashingEmbedder`` applied to ``{src}.{text}`` (every row of ``src``
    gets a vector; a text without tokens gets zeros)."""
    from .functions.embedder import TOKEN_CLASS
    D = int(dim)
    return f"""
{out}_t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), {q(TOKEN_CLASS)})) AS tok FROM {src}),
{out}_c AS (SELECT {key}, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % {D} AS b, count(*) AS c
            FROM {out}_t GROUP BY ALL),
{out}_n AS (SELECT {key}, CAST(sqrt(sum(c * c)) AS FLOAT) AS nrm, map_from_entries(list((b, c))) AS m
            FROM {out}_c GROUP BY {key}),
{out} AS (SELECT s.{key}, CASE WHEN n.nrm IS NULL THEN list_transform(range(0, {D}), lambda i: CAST(0 AS FLOAT))
                 ELSE list_transform(range(0, {D}), lambda i: CAST(coalesce(n.m[i], 0) / n.nrm AS FLOAT)) END AS v
          FROM {src} s LEFT JOIN {out}_n n USING ({key}))"""
