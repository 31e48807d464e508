"""Reading log files into entries and writing alerts.

Every parser takes lines (``file_path``, ``line_seq``, ``line``) and gives entries. Lines
that do not match are dropped; ``ingest`` counts and quarantines them.
"""
