"""Operators for text corpora: decontamination, packing, extraction, pseudonyms, models, fingerprints, joins, licences.

Every operator maps DataFrames to DataFrames. Only columns named in its docstring are read, so further columns with any
name are harmless. ``catalog`` registers one query for each operator.
"""
