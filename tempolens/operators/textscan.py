"""Text operators without Python row functions.

A49 finds, for every occurrence of a function name (NVL), the bracket
that opens its argument list, the first top-level comma and the closing
bracket, and reports each opening bracket inside the second argument (a
nested call).  Texts are cut into bracket/comma/name tokens with ``split`` on a
look-ahead pattern, and one ``aggregate`` walks the tokens of a text with a stack
of the calls that are open (no shuffle).  With ``chunk`` set, positions and depths
are running sums on fixed-size chunks of a text plus per-chunk offsets
(``running_sum``, ``next_value``) and bracket pairs are found per (text, depth)
by counting opens, so even one very long text is spread over many tasks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def section_between(text: Column | str, start_word: str, end_word: str) -> Column:
    """Text between the first `` start_word `` and the following `` end_word `` (to the end when missing)."""
    t = F.col(text) if isinstance(text, str) else text
    s = F.instr(F.upper(t), f" {start_word.upper()} ")
    tail = F.substring(t, s + F.lit(len(start_word) + 2), 1 << 30)
    e = F.instr(F.upper(tail), f" {end_word.upper()} ")
    return F.when(s > 0, F.when(e > 0, F.substring(tail, F.lit(1), e - 1)).otherwise(tail))


def regex_column_use(stmts: DataFrame, cols: DataFrame, stmt_table: str, col_table: str, text: str,
                     column_name: str, start_word: str = "SET", end_word: str = "WHERE") -> DataFrame:
    """Statements whose SET section names one of their table's columns as a word.

    Statements are paired only with the columns of their own table (equi
    join on the table name); a cheap ``contains`` test runs before the
    word-boundary regular expression.
    """
    s = stmts.withColumn("_section", F.upper(section_between(text, start_word, end_word)))
    c = cols.select(F.col(col_table).alias(stmt_table), F.upper(F.col(column_name)).alias("_col"),
                    F.col(column_name))
    j = s.join(c, stmt_table, "inner")
    word = F.concat(F.lit("\\b"), F.col("_col"), F.lit("\\b"))
    hit = F.col("_section").contains(F.col("_col")) & F.regexp_like(F.col("_section"), word)
    return j.filter(hit).drop("_section", "_col")


def running_sum(df: DataFrame, part: list[str], order: str, value: Column, out: str, chunk: int | None = None,
                inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` per ``part`` in ``order`` (numeric), without one window per part.

    Rows are cut into chunks of ``chunk`` consecutive order values; the sum
    runs inside (part, chunk) and each chunk adds the total of all earlier
    chunks, taken from a small window over one row per chunk.  A single very
    long text therefore spreads over many tasks.  There are as many offsets as
    chunks, so they are merged, not sent to every task (sizes taken from files
    know nothing of exploded rows).  ``chunk=None`` uses one
    window per part (cheaper when every part is small).
    """
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    if chunk is None:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(*frame)
        return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    c = "__rs_chunk"
    d = df.withColumn(c, F.floor(F.col(order) / F.lit(chunk))).withColumn("__rs_v", value)
    w = Window.partitionBy(*part, c).orderBy(order).rowsBetween(*frame)
    d = d.withColumn("__rs_local", F.coalesce(F.sum("__rs_v").over(w), F.lit(0)))
    tot = d.groupBy(*part, c).agg(F.sum("__rs_v").alias("__rs_t"))
    wo = Window.partitionBy(*part).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, c, F.coalesce(F.sum("__rs_t").over(wo), F.lit(0)).alias("__rs_off"))
    return d.join(off.hint("merge"), [*part, c], "inner") \
        .withColumn(out, F.col("__rs_local") + F.col("__rs_off")).drop(c, "__rs_v", "__rs_local", "__rs_off")


def next_value(df: DataFrame, part: list[str], order: str, value: str, out: str, chunk: int | None = None) -> DataFrame:
    """First non-NULL ``value`` at or after each row per ``part`` in ``order``, chunked like ``running_sum``."""
    if chunk is None:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        return df.withColumn(out, F.first(value, ignorenulls=True).over(w))
    c = "__nv_chunk"
    d = df.withColumn(c, F.floor(F.col(order) / F.lit(chunk)))
    w = Window.partitionBy(*part, c).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = d.withColumn("__nv_local", F.first(value, ignorenulls=True).over(w))
    firsts = d.groupBy(*part, c).agg(F.min(value).alias("__nv_min"))
    wn = Window.partitionBy(*part).orderBy(c).rowsBetween(1, Window.unboundedFollowing)
    nxt = firsts.select(*part, c, F.first("__nv_min", ignorenulls=True).over(wn).alias("__nv_next"))
    return d.join(nxt.hint("merge"), [*part, c], "inner") \
        .withColumn(out, F.coalesce("__nv_local", "__nv_next")).drop(c, "__nv_local", "__nv_next")


def _positions(df: DataFrame, id_col: str, arr: Column, out_pos: str, out_item: str, chunk: int | None = None) -> DataFrame:
    """posexplode an array of string pieces with the 1-based start position of each piece."""
    e = df.select(id_col, F.posexplode(arr).alias("_i", out_item))
    e = running_sum(e, [id_col], "_i", F.length(out_item), "_before", chunk=chunk, inclusive=False)
    return e.withColumn(out_pos, F.col("_before") + 1).drop("_before")


_CALL = "struct<call_no:bigint,rel:bigint>"
_FRAME = f"struct<level:int,calls:array<{_CALL}>,comma:bigint,first:int>"
_DONE = f"struct<calls:array<{_CALL}>,close:bigint,first:int,last:int>"


def _open_calls(text: Column, f: str) -> Column:
    """Finished calls of ``f`` in a text, with all opens seen below a second argument.

    The state holds the position, the depth, names that wait for their bracket, a
    stack of open calls (their level, the first comma directly inside) and what is
    finished.  ``opens`` gets an opening bracket only while some call on the stack
    has its comma; a call's own ones are the slice from its comma to its close.
    """
    tok = F.split(text, f"(?=[(),])|(?={re.escape(f)})")
    empty = lambda t: F.array().cast(f"array<{t}>")
    start = F.struct(F.lit(1).cast("bigint").alias("pos"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("n"),
                     empty(_CALL).alias("pending"), empty(_FRAME).alias("stack"), F.lit(0).alias("inside"),
                     empty("bigint").alias("opens"), empty(_DONE).alias("done"))

    def step(a: Column, x: Column) -> Column:
        ch = F.substring(x, 1, 1)
        name, opening, closing, comma = x.startswith(f), ch == "(", ch == ")", ch == ","
        waiting, size = F.size(a["pending"]), F.size(a["stack"])
        top, rest = F.try_element_at(a["stack"], F.lit(-1)), F.slice(a["stack"], F.lit(1), F.greatest(size - 1, F.lit(0)))
        ends = closing & (size > 0) & (top["level"] == a["depth"] - 1)
        splits = comma & (size > 0) & (top["level"] == a["depth"] - 1) & top["comma"].isNull()
        call = F.struct((a["n"] + 1).alias("call_no"), (a["pos"] + len(f) - 1).alias("rel"))
        pushed = F.struct(a["depth"].alias("level"), a["pending"].alias("calls"), F.lit(None).cast("bigint").alias("comma"), F.lit(0).alias("first"))
        marked = F.struct(top["level"].alias("level"), top["calls"].alias("calls"), a["pos"].alias("comma"), F.size(a["opens"]).alias("first"))
        out = F.struct(top["calls"].alias("calls"), a["pos"].alias("close"), top["first"].alias("first"), F.size(a["opens"]).alias("last"))
        return F.struct(
            (a["pos"] + F.length(x)).alias("pos"),
            (a["depth"] + F.when(opening, 1).when(closing, -1).otherwise(0)).alias("depth"),
            (a["n"] + F.when(name, 1).otherwise(0)).alias("n"),
            F.when(name, F.concat(a["pending"], F.array(call))).when(opening, empty(_CALL)).otherwise(a["pending"]).alias("pending"),
            F.when(opening & (waiting > 0), F.concat(a["stack"], F.array(pushed))).when(ends, rest)
             .when(splits, F.concat(rest, F.array(marked))).otherwise(a["stack"]).alias("stack"),
            (a["inside"] + F.when(splits, 1).when(ends & top["comma"].isNotNull(), -1).otherwise(0)).alias("inside"),
            F.when(opening & (a["inside"] > 0), F.concat(a["opens"], F.array(a["pos"]))).otherwise(a["opens"]).alias("opens"),
            F.when(ends & top["comma"].isNotNull(), F.concat(a["done"], F.array(out))).otherwise(a["done"]).alias("done"))

    return F.aggregate(tok, start, step, lambda a: F.struct(a["opens"].alias("opens"), a["done"].alias("done")))


def _scan_in_place(df: DataFrame, id_col: str, text_col: str, f: str) -> DataFrame:
    """The bracket scan inside each row: no shuffle, no window."""
    base = df.select(F.col(id_col).alias("_id"), F.upper(F.col(text_col)).alias("_u")).filter(F.col("_u").contains(f))
    d = base.withColumn("_s", _open_calls(F.col("_u"), f)).select("_id", "_u", "_s.opens", F.explode("_s.done").alias("_d"))
    d = d.filter(F.col("_d.last") > F.col("_d.first")) \
        .select("_id", "_u", F.col("_d.close").alias("_close"), F.explode("_d.calls").alias("_call"),
                F.slice("opens", F.col("_d.first") + 1, F.col("_d.last") - F.col("_d.first")).alias("_o"))
    d = d.select("_id", "_u", "_close", "_call.call_no", "_call.rel", F.explode("_o").alias("_o"))
    return d.select(F.col("_id").alias(id_col), "call_no", (F.col("_o") - F.col("rel")).alias("open_bracket_position"),
                    F.substring(F.col("_u"), (F.col("rel") + 1).cast("int"), (F.col("_close") - F.col("rel")).cast("int")).alias("call_parameter"))


def call_argument_scan(df: DataFrame, id_col: str, text_col: str, func: str = "NVL",
                       bucket: int = 256, chunk: int | None = None) -> DataFrame:
    """Opening brackets inside the second argument of every ``func(`` call.

    Output: id, call_no (n-th occurrence of ``func``), open_bracket_position
    (relative to the end of the name, as in the reference's rule),
    call_parameter (from after the name to the closing bracket).
    ``chunk``: None scans each text in its row (statement texts are small); a size
    such as 65536 splits very long texts into chunks.  A name whose end can be its
    own beginning (``AA``) is scanned in chunks of 65536, because the tokens of the
    scan in place would overlap.

    Defined cases: a null or empty text has no calls; a call without a comma or
    a closing bracket gives no rows; a closing bracket without an opening one is
    skipped; repeated rows are scanned each (with ``chunk`` ids must be unique).
    """
    overlaps = any(func.upper()[:k] == func.upper()[-k:] for k in range(1, len(func)))
    if chunk is None and not overlaps:
        return _scan_in_place(df, id_col, text_col, func.upper())
    chunk = chunk or 65536
    f = func.upper()
    base = df.select(F.col(id_col).alias("_id"), F.upper(F.col(text_col)).alias("_u"))
    # --- tokens '(' ')' ',' with position and depth
    tok = _positions(base, "_id", F.split("_u", "(?=[(),])"), "_pos", "_seg", chunk) \
        .withColumn("_ch", F.substring("_seg", 1, 1)).filter(F.col("_ch").isin("(", ")", ","))
    delta = F.when(F.col("_ch") == "(", 1).when(F.col("_ch") == ")", -1).otherwise(0)
    tok = running_sum(tok, ["_id"], "_pos", delta, "_after", chunk=chunk)
    tok = tok.withColumn("_lvl", F.when(F.col("_ch") == "(", F.col("_after") - 1)
                         .when(F.col("_ch") == ")", F.col("_after")).otherwise(F.col("_after") - 1))
    # --- bracket pairs per (text, level): group = running count of opens
    tok = running_sum(tok, ["_id", "_lvl"], "_pos", F.when(F.col("_ch") == "(", 1).otherwise(0), "_g", chunk=chunk)
    pairs = (tok.filter(F.col("_g") > 0).groupBy("_id", "_lvl", "_g")
             .agg(F.min(F.when(F.col("_ch") == "(", F.col("_pos"))).alias("_open"),
                  F.min(F.when(F.col("_ch") == ",", F.col("_pos"))).alias("_comma"),
                  F.min(F.when(F.col("_ch") == ")", F.col("_pos"))).alias("_close")))
    # --- occurrences of the function name; each takes the next '(' after it.
    # Piece i (>= 1) of split(text, name) follows the i-th occurrence, which
    # starts at 1 + (length of pieces before) + len(name) * (i - 1).
    parts = _positions(base, "_id", F.split("_u", re.escape(f)), "_p0", "_part", chunk).filter(F.col("_i") > 0)
    calls = parts.select("_id", F.col("_i").cast("bigint").alias("call_no"),
                         (F.col("_p0") + F.lit(len(f)) * (F.col("_i") - 1)).alias("_name_pos"))
    opens = tok.filter(F.col("_ch") == "(").select("_id", F.col("_pos").alias("_ev"), F.col("_pos").alias("_open"))
    stream = calls.select("_id", (F.col("_name_pos") + len(f)).alias("_ev"), "call_no", "_name_pos") \
        .unionByName(opens, allowMissingColumns=True)
    # a call and the '(' right after its name share a position: the call sorts first
    stream = stream.withColumn("_evk", F.col("_ev") * 2 + F.when(F.col("call_no").isNull(), 1).otherwise(0))
    stream = next_value(stream, ["_id"], "_evk", "_open", "_next_open", chunk=2 * chunk)
    calls = stream.filter(F.col("call_no").isNotNull()).select("_id", "call_no", "_name_pos", "_next_open")
    calls = calls.join(pairs.withColumnRenamed("_open", "_next_open").hint("merge"), ["_id", "_next_open"], "inner") \
        .filter(F.col("_comma").isNotNull() & (F.col("_comma") < F.col("_close")))
    # --- opens inside (comma, close): bucketed range join on the same text
    b = F.lit(bucket)
    iv = calls.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_comma") / b), F.floor(F.col("_close") / b))))
    op = tok.filter(F.col("_ch") == "(").select("_id", F.col("_pos").alias("_o"), F.floor(F.col("_pos") / b).alias("_b"))
    hit = iv.join(op.hint("merge"), ["_id", "_b"], "inner").filter((F.col("_o") > F.col("_comma")) & (F.col("_o") < F.col("_close")))
    rel = F.col("_name_pos") + len(f) - 1
    out = hit.join(base.hint("merge"), "_id", "inner").select(
        F.col("_id").alias(id_col), "call_no",
        (F.col("_o") - rel).cast("bigint").alias("open_bracket_position"),
        F.substring(F.col("_u"), (rel + 1).cast("int"), (F.col("_close") - rel).cast("int")).alias("call_parameter"))
    return out
