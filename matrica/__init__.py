"""matrica: a Spark-native analytics engine for annotated numeric matrices.

Matrices are DataFrames in long form (absent cell = zero), embeddings are
array columns, metadata are ordinary tables.  Subpackages:

``functions``  expression builders (ranks, distances, distribution tails)
``operators``  one module per operator family
``sources``    readers and writers
``plans``      end-to-end analyses composed of operators
``streaming``  incremental forms of the count operators
"""

__version__ = "0.1.0"
