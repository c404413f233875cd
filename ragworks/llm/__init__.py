"""Training-data operators: deduplication, filters, scans and tokenisation of large corpora."""
