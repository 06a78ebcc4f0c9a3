"""tokenloom — Spark jobs for code/text corpora and the token budgets spent reading them.

Layout:
  sources/    readers and writers (driver tables, file trees, ledger, config layers, change feeds)
  functions/  Column-level helpers (text, paths, vectors) — pure pyspark.sql.functions
  operators/  DataFrame -> DataFrame jobs (ledger, corpus, references, vectors, tree, config, outline)
  plans/      the query catalog used by __spark_entry__.py, bench.py and the tests
  streaming/  Structured Streaming forms of the index sync, daily usage and admission gate
"""

from tokenloom.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
