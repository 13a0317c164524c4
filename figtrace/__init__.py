"""figtrace: evidence analytics over large tables of extracted figures, on Spark.

A *points* table holds one number per row, taken from a document, together with its metric,
entity, year, unit, source path, cell and surrounding text. Everything here takes and returns
DataFrames; see README.md for a tour.
"""

__version__ = "0.1.0"
