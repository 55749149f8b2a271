"""Guarded arithmetic and packed-number decoding.

Spark runs with ANSI mode on, where x/0 raises; every ratio in the library
goes through one of these helpers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col


def per_unit(num, den) -> Column:
    """num / den where a zero divisor counts as 1 (the DECODE(x,0,1,x) rule)."""
    d = as_col(den)
    return as_col(num) / F.when(d == 0, F.lit(1)).otherwise(d)


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(as_col(num), as_col(den))


def pct(num, den, scale: int | None = None) -> Column:
    """100 * num / den, NULL for a zero divisor; optional rounding."""
    r = F.try_divide(as_col(num) * F.lit(100.0), as_col(den))
    return F.round(r, scale) if scale is not None else r


def hit_ratio(gets, reads) -> Column:
    """Cache hit percent 100*(gets-reads)/greatest(gets,1)."""
    g, r = as_col(gets), as_col(reads)
    return F.lit(100.0) * (g - r) / F.greatest(g, F.lit(1))


def bit_set(col, bit: int) -> Column:
    """BITAND(col, bit) = bit."""
    return (as_col(col).bitwiseAND(F.lit(bit))) == F.lit(bit)


def bitmask_decode(col, names: dict[int, str], sep: str = ", ") -> Column:
    """Names of all bits set in ``col``, joined in bit order."""
    c = as_col(col)
    return F.concat_ws(sep, *[F.when(bit_set(c, b), F.lit(n)) for b, n in sorted(names.items())])


def decode_packed(p, low_bits: int = 16) -> tuple[Column, Column]:
    """Split a packed wait parameter into (high word, low word)."""
    c = as_col(p).cast("bigint")
    return F.shiftright(c, low_bits), F.pmod(c, F.lit(1 << low_bits))


def split_word(p, wordsize: int = 8) -> tuple[Column, Column]:
    """High and low half of a packed value on a ``wordsize``-byte platform.

    Mutex waits pack the blocker's SID into the top half of P2 and the
    shared-reference count into the bottom half (shift = 4 * wordsize bits).
    """
    return decode_packed(p, 4 * wordsize)


def block_class(p3, p3text) -> tuple[Column, Column]:
    """Block class of a buffer/gc wait and the undo segment folded into it.

    class id = p3 % 65536 for 'id#', p3 itself for 'class#'; ids above 19
    carry an undo segment n (id = 2n + 15 + class offset): the segment is
    floor((id - 15) / 2) and the remaining id is id - (n - 1) * 2.
    """
    v, t = as_col(p3).cast("bigint"), as_col(p3text)
    cid = F.when(t == F.lit("id#"), F.pmod(v, F.lit(65536))).when(t == F.lit("class#"), v)
    undo = F.when(cid > 19, F.floor((cid - 15) / 2))
    return F.when(cid > 19, cid - (undo - 1) * 2).otherwise(cid), undo
