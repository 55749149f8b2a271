"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong patterns (assignments, access keys, hex strings) are always reported.
Weak candidates -- user names, opaque tokens, endpoints -- are reported only when
complementary parts of a credential stand near them: an interval join links the
parts of one text that lie within a scope of each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import join_null_safe, text_key


@dataclass(frozen=True)
class Part:
    """A pattern whose ``group`` has ``least`` characters or more, and its role in a credential."""

    kind: str
    pattern: str
    role: str
    strong: bool = False
    group: int = 0
    least: int = 0


#: In the order in which spans of one start are listed.
PARTS = (
    Part("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", True, 2, 6),
    Part("access", r"AKIA[A-Z0-9]+", "identifier", True, 0, 20),
    Part("hex", r"[0-9a-f]{24,}+", "secret", True, 0, 24),
    Part("login", r"""\b(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", "identifier", False, 1, 3),
    Part("opaque", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}+={0,2}", "secret", False, 0, 32),
    Part("endpoint", r"\b[a-z][a-z0-9+]{2,9}://[A-Za-z0-9._~:/?#@%&=+-]+", "endpoint", False, 0, 8),
)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All parts of all texts: id, rk (row key), kind number, role, strong, start and end in code points.

    A pattern's matches are leftmost and do not overlap.  The text between two
    matches and the match lengths give the positions: their running sum over the
    matches of a row.
    """
    src = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    text = F.col("text")
    some = None
    for p in PARTS:
        some = text.rlike(p.pattern) if some is None else some | text.rlike(p.pattern)
    # strong parts are reported in any case; a weak one needs others, so rows without any go early
    rows = src.where(some)

    def matches(p: Part) -> Column:
        got, gaps = F.regexp_extract_all("text", F.lit(p.pattern), F.lit(0)), F.split("text", p.pattern, -1)
        size = F.regexp_extract_all("text", F.lit(p.pattern), F.lit(p.group)) if p.group else got
        zipped = F.zip_with(got, size, lambda m, g: F.struct(F.length(m).alias("n"), F.length(g).alias("g")))
        return F.zip_with(zipped, F.slice(gaps, 1, F.greatest(F.size(got), F.lit(1))), lambda m, x: F.struct(
            m["n"].alias("n"), m["g"].alias("g"), F.length(x).alias("gap")))

    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(text.rlike(p.pattern), matches(p)).alias("m")) for k, p in enumerate(PARTS)])
    packed = rows.select("id", "rk", F.filter(kinds, lambda x: x["m"].isNotNull()).alias("kinds")).dropDuplicates(["id", "rk"])
    each = packed.select("id", "rk", F.explode("kinds").alias("k")).select("id", "rk", "k.kind", F.posexplode("k.m").alias("i", "m"))
    run = Window.partitionBy("id", "rk", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.n") + F.col("m.gap")).over(run)
    placed = each.select("id", "rk", "kind", end.alias("end"), F.col("m.n").alias("n"), F.col("m.g").alias("g"))
    least = F.element_at(F.array(*[F.lit(p.least) for p in PARTS]), F.col("kind") + 1)
    return placed.where(F.col("g") >= least).select(
        "id", "rk", "kind", F.element_at(F.array(*[F.lit(p.role) for p in PARTS]), F.col("kind") + 1).alias("role"),
        F.element_at(F.array(*[F.lit(p.strong) for p in PARTS]), F.col("kind") + 1).alias("strong"),
        (F.col("end") - F.col("n")).alias("start"), "end")


def link_parts(parts: DataFrame, scope: int = 256) -> DataFrame:
    """The parts to report: strong ones, and weak ones with their complement within ``scope`` code points.

    A weak secret needs an identifier near it, a weak identifier a secret, and an
    endpoint both.  Parts are near when the gap between them is at most ``scope``.
    The join is by text and stretch of ``scope`` code points: a part stands in
    the stretches that it touches, a weak one looks into those within reach.
    """
    def stretches(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))

    known = parts.where(F.col("role") != "endpoint").select(
        F.col("id").alias("o_id"), F.col("rk").alias("o_rk"), F.col("role").alias("o_role"), F.col("start").alias("o_start"),
        F.col("end").alias("o_end"), stretches(F.col("start"), F.col("end")).alias("s"))
    # parts of a kind do not overlap, so a stretch holds few
    near = known.groupBy("o_id", "o_rk", "o_role", "s").agg(
        F.collect_set(F.struct("o_start", "o_end")).alias("o"))
    weak = parts.where(~F.col("strong")).withColumn("s", stretches(F.col("start") - scope, F.col("end") + scope))
    close = F.exists("o", lambda o: (o["o_start"] - F.col("end") <= scope) & (F.col("start") - o["o_end"] <= scope))
    joined = weak.join(near, weak["id"].eqNullSafe(near["o_id"]) & (weak["rk"] == near["o_rk"]) & (weak["s"] == near["s"]) & close)
    needs = F.when(F.col("role") == "secret", F.col("identifier")).when(F.col("role") == "identifier", F.col("secret")) \
        .otherwise(F.col("identifier") & F.col("secret"))
    linked = (joined.groupBy("id", "rk", "kind", "role", "strong", "start", "end")
              .agg(F.bool_or(F.col("o_role") == "identifier").alias("identifier"), F.bool_or(F.col("o_role") == "secret").alias("secret"))
              .where(needs).select(*parts.columns))
    return parts.where("strong").unionByName(linked)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 256) -> DataFrame:
    """One row for each row of ``docs``: the id and ``spans``, an array of (start, kind, end, name) sorted
    by start, then kind.

    Defined cases: a null or empty text has no spans; rows equal in id and text
    get the same spans; a null id is an id; an empty table gives no rows; other
    columns are not read.
    """
    parts = link_parts(find_parts(docs, id_col, text_col), scope)
    name = F.element_at(F.array(*[F.lit(p.kind) for p in PARTS]), F.col("kind") + 1)
    spans = parts.groupBy("id", "rk").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", name.alias("name")))).alias("spans"))
    rows = docs.select(F.col(id_col).alias("id"), text_key(id_col, text_col).alias("rk"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,name:string>>")
    return join_null_safe(rows, spans, ["id", "rk"], "left").select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))
