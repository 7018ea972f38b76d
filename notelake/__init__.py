"""notelake: a Spark-first engine for note collections, their chunks and their embedding vectors.

Layers: ``sources`` read and write tables, ``functions`` are column expressions,
``operators`` are DataFrame -> DataFrame functions, ``streaming`` holds the
Structured Streaming jobs, ``plans`` the named queries and their SQL twins.
``llm`` (optional, nothing else imports it) has the training-data operators.
"""

__version__ = "0.1.0"
