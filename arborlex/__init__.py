"""arborlex: retrieval analytics over hierarchical document corpora, as Spark DataFrame programs."""
