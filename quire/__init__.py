"""quire: a Spark-native engine for document corpora and the catalogs around them."""
