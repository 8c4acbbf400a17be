"""DataFrame operators on paragraphs, sentences, vectors, pairs and catalogs."""
