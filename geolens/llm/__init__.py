"""Operators for preparing training text: near duplicates, rules, secrets, archives, packing and others."""
