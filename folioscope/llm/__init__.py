"""Operators for preparing training text: identification, scoring, cleaning, packing and mixing."""
