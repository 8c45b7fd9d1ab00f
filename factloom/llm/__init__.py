"""Training-data operators over a corpus of documents. Nothing else in the package imports this one."""
