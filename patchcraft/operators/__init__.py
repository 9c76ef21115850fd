"""Table-to-table operators; each is ``DataFrame -> DataFrame``."""
