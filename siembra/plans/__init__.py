"""Registered queries of the analytics library and their SQL oracles."""
