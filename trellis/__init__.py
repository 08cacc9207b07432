"""Trellis: spatial-network analytics expressed as Spark DataFrame plans."""
