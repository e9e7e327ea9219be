"""Operators for preparing training text: filters, deduplication, decontamination, tokens and packing."""
