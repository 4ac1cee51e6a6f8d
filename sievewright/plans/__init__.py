"""Registered queries of the core: name -> callable(spark, sf_dir), and their SQL where SQL can say it."""

from sievewright.plans import audit, more, packed, pages, scores, streams, tables

QUERIES = {**packed.QUERIES, **tables.QUERIES, **more.QUERIES, **audit.QUERIES, **scores.QUERIES, **pages.QUERIES, **streams.QUERIES}
ORACLE = {**packed.ORACLE, **tables.ORACLE, **more.ORACLE, **audit.ORACLE, **scores.ORACLE, **pages.ORACLE, **streams.ORACLE}
