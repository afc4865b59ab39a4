"""Operators for preparing training text: deduplication, filtering, mixing, sharding, archives, chat formatting."""
