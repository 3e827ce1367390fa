"""Inputs derived from the given tables, for registered queries and tests. No part of the engine."""
