"""Spark-native analytics for multi-lead signals and question/answer annotations.

Every public operator takes and returns DataFrames. Sub-packages:

- ``sources``   annotation/signal/prompt readers, materialisation sinks, stand-in views
- ``functions`` column expressions (text parsing, set equality, Dice, formatting)
- ``operators`` DataFrame operators (ordering, batching, pair scores, signal
                features, vectors, token sequences, evaluation, run monitoring)
- ``plans``     the three end-to-end flows and the query catalog
- ``streaming`` Structured Streaming forms of the stateful operators
"""

from wavequery.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
