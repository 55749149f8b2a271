"""Every ASH dimension as group-by, each with every other dimension as filter (value and NULL)."""

from pyspark.sql import functions as F

from tempolens.plans import ash
from tempolens.sources import fixture

from conftest import SF001


def test_all_dimension_pairs(spark):
    samples = ash.weighted_samples(fixture(spark, SF001, "fx_ash"), fixture(spark, SF001, "fx_ash_live")).cache()
    reg = ash.ash_dimensions(samples.columns)
    total = samples.count()
    first = {d: samples.select(reg[d].alias("v")).filter(F.col("v").isNotNull()).orderBy("v").first()["v"] for d in reg}
    for by in reg:
        g = ash.grouping(samples, by)
        assert g.agg(F.sum("count_samples")).first()[0] == total
        for f in reg:
            if f == by:
                continue
            for v in (first[f], None):
                sub = ash.grouping(samples, by, {f: v})
                want = samples.filter(reg[f] == F.lit(v) if v is not None else reg[f].isNull()).count()
                got = sub.agg(F.sum("count_samples")).first()[0] or 0
                assert got == want, (by, f, v)
    samples.unpersist()
