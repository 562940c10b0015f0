"""Unicode forms and string similarity as Arrow-batched functions; Spark has no built-in for either."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from quillspan.functions.bounds import Matcher, close_letters
from quillspan.functions.text import ascii_kebab, ascii_topic, col, strip, wikilinks, without_index_prefix

_ASCII = r"^\p{ASCII}*$"


def _normal_form(form: str):
    @pandas_udf(StringType())
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return f


_nfc, _nfkc = _normal_form("NFC"), _normal_form("NFKC")


@pandas_udf(StringType())
def _nfkd_ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii"))


@pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def slug(x: str, cut: int = 80) -> str:
    """The slug of one title, for use inside Arrow functions."""
    plain = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode("ascii").lower()
    return re.sub("[^a-z0-9]+", "-", plain).strip("-")[:cut].rstrip("-") or "untitled-note"


@pandas_udf(ArrayType(StringType()))
def _with_slugs(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else sorted({y for x in xs for z in (unicodedata.normalize("NFC", x).strip(),) for y in (z.lower(), slug(z))}))


def nfc(c) -> Column:
    """NFC; plain ASCII goes unchanged past the Arrow function's result."""
    return F.when(col(c).rlike(_ASCII), col(c)).otherwise(_nfc(col(c)))


def nfkd_ascii(c) -> Column:
    """NFKD without all that is not ASCII (so a sharp s is deleted, a ligature is spelt out)."""
    return F.when(col(c).rlike(_ASCII), col(c)).otherwise(_nfkd_ascii(col(c)))


def kebab_case(c, cut: int = 80) -> Column:
    return ascii_kebab(nfkd_ascii(c), cut)


def topic(c, cut: int = 50) -> Column:
    """Archive topic of an index note's title; NULL gives 'Untitled'."""
    return ascii_topic(nfkd_ascii(without_index_prefix(c)), cut)


def repeat_key(c) -> Column:
    """What repeated page headers have in common: NFKC, blanks made single, digits as '#', lower case."""
    x = F.when(col(c).rlike(_ASCII), col(c)).otherwise(_nfkc(col(c)))
    return F.lower(strip(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"(?U)\d+", "#")))


def ratio(a, b) -> Column:
    """Ratcliff-Obershelp similarity of two texts, in this order (it is not symmetric)."""
    return _ratio(col(a), col(b))


def ratio_at_least(a, b, threshold: float) -> Column:
    """``ratio`` where it reaches ``threshold``, else NULL; cheap bounds come before the exact comparison."""

    @pandas_udf(DoubleType())
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        m = Matcher(threshold)
        may = close_letters(x.fillna("").tolist(), y.fillna("").tolist(), threshold) & x.notna().to_numpy() & y.notna().to_numpy()
        out = [None] * len(x)
        for k, ok in enumerate(may.tolist()):
            if ok:
                m.set(y.iloc[k])
                out[k] = m.ratio(x.iloc[k])
        return pd.Series(out, dtype="float64")

    return f(col(a), col(b))


def ratio_bound(a, b) -> Column:
    """A bound on ``ratio`` from the lengths alone, for use before it."""
    la, lb = F.length(col(a)), F.length(col(b))
    return F.when(la + lb == 0, 1.0).otherwise(2.0 * F.least(la, lb) / (la + lb))


def link_target_keys(body, related, cross) -> Column:
    """All link targets of a note, each in lower case and as slug: links in the body and entries of two arrays
    (an entry without brackets counts as a target itself)."""
    entry = lambda e: F.coalesce(F.get(wikilinks(e), F.lit(0)), strip(e))
    listed = F.concat(*[F.transform(F.coalesce(col(x), F.array().cast("array<string>")), entry) for x in (related, cross)])
    targets = F.filter(F.concat(wikilinks(body), listed), lambda t: t.isNotNull() & (t != ""))
    return _with_slugs(targets)
