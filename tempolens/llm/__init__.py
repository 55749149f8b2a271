"""Operators for preparing training corpora (deduplication, decontamination,
secret scans, extraction, packing, language ID, formatting, token files).

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` in :mod:`tempolens.llm.queries` hold the registered queries.
"""
