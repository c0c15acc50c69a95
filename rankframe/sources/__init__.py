from .testdata import STOPWORDS, derive_qrels, load_docs, load_queries, stopword_frame, table

__all__ = ["STOPWORDS", "derive_qrels", "load_docs", "load_queries", "stopword_frame", "table"]
