"""Operators for large text corpora: extraction, search, deduplication, scans, tokenisation. Nothing else imports them."""
