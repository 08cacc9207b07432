"""Relational, spatial and network operators over DataFrames."""
