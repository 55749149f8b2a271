"""Text helpers: labels, flag lists, case-insensitive search."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def nvl_text(col, default: str = "NULL") -> Column:
    """Text form of a value with a marker for NULL (Oracle NVL(TO_CHAR(x), 'NULL'))."""
    return F.coalesce(as_col(col).cast("string"), F.lit(default))


def code_label(col, mapping: dict, default=None) -> Column:
    """Translate codes through a literal map; unknown codes -> default (or the code).

    The map is a literal inside the expression, so the lookup stays in
    whole-stage codegen and needs no join.
    """
    c = as_col(col)
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    fallback = F.lit(default) if default is not None else c.cast("string")
    return F.coalesce(F.try_element_at(m, c), fallback)


def flags_to_list(flags: dict[str, str], yes: str = "Y", sep: str = ", ") -> Column:
    """Names of the flag columns whose value is ``yes``, comma separated."""
    return F.concat_ws(sep, *[F.when(F.col(c) == F.lit(yes), F.lit(name)) for c, name in flags.items()])


def contains_ci(cols, term: str, combine: str = "or") -> Column:
    """Case-insensitive containment of ``term`` in any (or the concatenation) of cols."""
    cols = [as_col(c) for c in ([cols] if isinstance(cols, (str, Column)) else cols)]
    t = F.lit(term.upper())
    if combine == "concat":
        return F.upper(F.concat_ws("", *cols)).contains(t)
    out = None
    for c in cols:
        e = F.coalesce(F.upper(c.cast("string")).contains(t), F.lit(False))
        out = e if out is None else (out | e)
    return out


def short_text(col, n: int = 40) -> Column:
    """First ``n`` characters of a statement text."""
    return F.substring(as_col(col), 1, n)


def format_number_locale(col, decimals: int = 0, locale: str = "en") -> Column:
    """Number with thousands separators; German locale swaps '.' and ',' (A59)."""
    s = F.format_number(as_col(col), decimals)
    return F.translate(s, ",.", ".,") if locale == "de" else s
