"""Preparation of training text: duplicates, representatives, encodings, pairs, packing, leaks and personal data."""
