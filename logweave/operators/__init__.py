"""Relational and ordered operators over event DataFrames."""
