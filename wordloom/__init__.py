"""wordloom: corpus preparation and byte-level BPE tokenisation on Spark."""

__version__ = "0.1.0"
