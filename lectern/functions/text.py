"""Text expressions: null handling, keyword lists, character whitelist,
whitespace, concatenation of non-empty parts, fingerprints, blank test.

All return ``Column`` objects built from ``pyspark.sql.functions`` so they
stay inside whole-stage codegen.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Whitespace as Python's ``re`` ``\s`` understands it for str patterns:
# ASCII controls 09-0D and 1C-1F, U+0085, and the Unicode separators
# (category Z: U+0020, U+00A0, U+1680, U+2000-U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000). Java's and RE2's ``\s`` are narrower, so the
# class is spelled out; ``\p{Z}`` is one category test in both engines and
# several times faster in Java than listing the code points.
WS_CLASS_BODY = r"\t\n\x0B\f\r\x1C-\x20\x{85}\p{Z}"
# Characters kept by the cleaner besides letters, digits and whitespace.
KEPT_PUNCTUATION = ".,'?!"
KEPT_LETTERS = "àâéèêëîïôùûüçÀÂÉÈÊËÎÏÔÙÛÜÇ"
# ---------------------------------------------------------------------------

WS_RUN = f"[{WS_CLASS_BODY}]+"
# Anything outside the whitelist; '-' last so it is literal.
NOT_KEPT = f"[^a-zA-Z0-9{WS_CLASS_BODY}{KEPT_PUNCTUATION}{KEPT_LETTERS}-]"
# A run of anything that T4 does not keep, whitespace included. Every kept
# character is named: Java tests such a class by one table, ranges one by one.
NOT_KEPT_RUN = f"[^{string.ascii_letters}{string.digits}{KEPT_PUNCTUATION}{KEPT_LETTERS}-]+"
BLANK = f"^[{WS_CLASS_BODY}]*$"


def col_or_name(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_to_empty(c) -> Column:
    """Null -> '', anything -> string."""
    return F.coalesce(col_or_name(c).cast("string"), F.lit(""))


def join_keywords(c, sep: str = ", ") -> Column:
    """A raw keyword field holding a JSON list, a plain string or null.

    A JSON list is joined with ``sep`` (an empty list gives ''), any other
    text is kept as is, null gives ''.
    """
    c = col_or_name(c)
    as_list = F.from_json(c, "array<string>")
    return (F.when(c.isNull(), F.lit(""))
            .when(as_list.isNotNull(), F.array_join(as_list, sep))
            .otherwise(c))


def keep_whitelist(c) -> Column:
    """T4: characters outside the whitelist become a space."""
    return F.regexp_replace(col_or_name(c), NOT_KEPT, " ")


def squash_spaces(c) -> Column:
    """T5: whitespace runs -> one space, then strip.

    After the collapse only U+0020 can sit at either end, so ``trim`` (which
    strips U+0020 only) is a full strip here.
    """
    return F.trim(F.regexp_replace(col_or_name(c), WS_RUN, " "))


def squash_whitelist(c) -> Column:
    """T4 then T5 in one pass: characters outside the whitelist become spaces,
    and so does whitespace, so each run of either is one space."""
    return F.trim(F.regexp_replace(col_or_name(c), NOT_KEPT_RUN, " "))


def join_nonempty(cols, sep: str = " . ") -> Column:
    """Join the non-empty values of ``cols`` with ``sep``."""
    arr = F.array(*[col_or_name(c) for c in cols])
    return F.array_join(F.filter(arr, lambda x: x != F.lit("")), sep)


def fingerprint_text(c) -> Column:
    """Lower case, whitespace runs -> one space, strip."""
    return F.trim(F.regexp_replace(F.lower(col_or_name(c)), WS_RUN, " "))


def fingerprint(c, squashed: bool = False) -> Column:
    """D1 as a fixed-width shuffle key: SHA-256 of the normalised text.

    Shuffling 64 hex characters instead of whole documents keeps the
    dedup exchange small whatever the document length. ``squashed`` says
    the text already went through T5 (single spaces, stripped), as cleaned
    text does; lower-casing adds no whitespace, so the whitespace pass is
    skipped and the key is the same.
    """
    norm = F.lower(col_or_name(c)) if squashed else fingerprint_text(c)
    return F.sha2(norm, 256)


def is_blank(c) -> Column:
    """Null, empty or whitespace only."""
    c = col_or_name(c)
    return c.isNull() | c.rlike(BLANK)


def preview(c, n: int = 200, suffix: str = "...") -> Column:
    """First ``n`` code points plus a suffix."""
    return F.concat(F.substring(col_or_name(c), 1, n), F.lit(suffix))
