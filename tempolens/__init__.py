"""tempolens: performance-history analytics as Spark DataFrame operators.

Layout
------
functions/  Column-level helpers (time buckets, safe division, labels, first/last-by).
operators/  Generic, column-parametrised DataFrame -> DataFrame operators.
plans/      Ready-made reports and the rule-check registry composed from operators.
streaming/  Structured Streaming forms of the operators that make sense on arriving data.
sources/    Table loading, fixture bindings over the test tables, text-log reader.
suite/      The registered queries (Spark side + DuckDB oracle SQL) used by the checks.
"""

__version__ = "0.1.0"
