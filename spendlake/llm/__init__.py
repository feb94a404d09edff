"""Training-data operators: deduplication, mixing, decontamination, extraction, scans,
packing and filters over a document corpus.  Nothing else in the library imports this
subpackage; its registered queries are in ``queries.py``."""
