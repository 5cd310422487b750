"""Vicinal: labelled nearest-neighbour scoring as Spark DataFrame operators."""
