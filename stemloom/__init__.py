"""stemloom: a Spark engine for large multitrack-audio catalogs and training corpora."""
