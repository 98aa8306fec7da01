"""Operators for preparing training text: files of token ids, deduplication, quality, decontamination, personal data."""
