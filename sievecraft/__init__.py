"""Spark-native curation and training-target preparation.

Sub-packages
    functions   Column -> Column expressions
    operators   DataFrame -> DataFrame building blocks
    sources     readers and writers
    plans       whole jobs made of the operators
    streaming   the same jobs on an unbounded input
"""

__version__ = "0.1.0"
