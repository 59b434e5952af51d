"""textloom: Spark jobs for text corpora, annotations and knowledge tables."""
