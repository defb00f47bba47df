"""Corpus jobs on Spark: documents as tables of blocks, inlines, labels, references and citations."""
