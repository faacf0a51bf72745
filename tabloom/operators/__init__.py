"""Operators: profile, distributions, encoding, information, networks, generation, reports."""
