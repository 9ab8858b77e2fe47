"""Operators beside the query languages: discovery, rollups, errors, reliability, rules, patterns."""
