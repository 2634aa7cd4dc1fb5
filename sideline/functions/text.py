"""Text normalisation as column expressions.

Everything stays in the JVM except Unicode compatibility folding, which Spark
has no builtin for; that one step is an Arrow UDF which only receives the rows
that contain a non-ASCII character, and ``ascii_only=True`` leaves it out.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sideline.schemas import TEAM_ALIASES

_LABELS = "Video Forecast|New Player Note|No new player Notes"


@F.pandas_udf(T.StringType())
def _fold_compatibility(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


# A run of characters outside ASCII with the one before it, which a combining mark may join. Nothing in a text composes across
# the ends of such a run: an ASCII character starts anew.
_RUN = r"[\x00-\x7F]?[^\x00-\x7F]+"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_runs(values: pd.Series) -> pd.Series:
    return values.map(lambda runs: [unicodedata.normalize("NFKC", r) for r in runs], na_action="ignore")


def fold_compatibility(c: Column) -> Column:
    """Compatibility folding of a whole value, for callers that take it apart in lambdas, where no UDF can stand.

    Only the runs outside ASCII pass through Python, so that a batch of long pages does not.
    """
    text = c.cast("string")
    runs = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    folded = F.concat(_fold_runs(F.when(text.rlike(r"[^\x00-\x7F]"), runs)), F.array(F.lit("")))
    return F.coalesce(F.array_join(F.zip_with(F.split(text, _RUN, -1), folded, lambda between, run: F.concat(between, run)), ""), text)


def clean_text(c: Column, *, ascii_only: bool = False) -> Column:
    """Null to "", compatibility folding, straight apostrophes, single spaces, trimmed."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    if not ascii_only:
        text = F.coalesce(_fold_compatibility(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    text = F.translate(text, " ’`", " ''")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def name_key(c: Column, *, ascii_only: bool = False) -> Column:
    """Comparable person name: lower case, no decorations, suffixes or punctuation."""
    n = F.lower(clean_text(c, ascii_only=ascii_only))
    n = F.regexp_replace(F.regexp_replace(n, r"\[[^\]]*\]", " "), r"\([^)]*\)", " ")
    n = F.regexp_replace(n, r"\b(jr|sr|ii|iii|iv|v)\.?\b", " ")
    n = F.regexp_replace(F.translate(n, "'", ""), "[^a-z0-9]+", " ")
    return F.trim(n)


@F.pandas_udf(T.StringType())
def _ascii_base(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode(), na_action="ignore")


def fold_ascii(c: Column) -> Column:
    """Compatibility forms and accents to their ASCII base; only values with a non-ASCII character enter the step."""
    n = F.coalesce(c.cast("string"), F.lit(""))
    return F.coalesce(_ascii_base(F.when(n.rlike(r"[^\x00-\x7F]"), n)), n)


def compact_key(c: Column, *, folded: bool = False) -> Column:
    """Alternative name key: ASCII base, suffix words dropped, letters and digits only.

    ``folded`` is for values that have been through :func:`fold_ascii`, as inside lambdas, where no UDF can stand.
    """
    n = F.lower(c if folded else fold_ascii(c))
    n = F.regexp_replace(n, r"\b(?:jr|sr|ii|iii|iv|v)\.?\b", "")
    return F.regexp_replace(n, "[^a-z0-9]", "")


def team_code(c: Column, *, ascii_only: bool = False) -> Column:
    """Upper-case club code with source spellings unified."""
    code = F.upper(clean_text(c, ascii_only=ascii_only))
    pairs = [F.lit(v) for kv in TEAM_ALIASES.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def strip_labels(c: Column, *, ascii_only: bool = False) -> Column:
    """Remove interface labels glued to a copied name, keeping any status letters."""
    n = clean_text(c, ascii_only=ascii_only)
    n = F.regexp_replace(n, f"(?i)(?:{_LABELS}).*$", "")
    n = F.regexp_replace(n, "(?i)(?:IR)?Player Note.*$", "")
    return F.trim(n)


def strip_labels_and_status(c: Column) -> Column:
    """Remove labels, then a status code attached to a lower-case letter or full stop."""
    n = F.trim(F.regexp_replace(c, f"(?is)(?:{_LABELS}|Player Note).*$", ""))
    return F.trim(F.regexp_replace(n, r"(?<=[a-z.])(?:IR-R|PUP-R|IR|PUP|CEL|Q|O|D|P)$", ""))


def inline_status(c: Column, *, ascii_only: bool = False) -> Column:
    """Status token that stands right before a label or the end of the line, else ""."""
    pattern = f"(?i)(IR-R|PUP-R|IR|O|Q|D|P)(?=(?:{_LABELS}|Player Note|$))"
    return F.upper(F.regexp_extract(clean_text(c, ascii_only=ascii_only), pattern, 1))


def title_case(c: Column) -> Column:
    """Capital after every non-letter, the rest lower case."""
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))),
        "",
    )


def blank_to_null(c: Column) -> Column:
    """A blank id is no id; as null it can never satisfy a join."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))
