"""passagekit: building and evaluating passage-retrieval corpora on Spark.

Every operator is a function from DataFrame(s) to a DataFrame.  Nothing is
collected to the driver; per-row Python only appears inside Arrow-batched
``mapInPandas`` / ``applyInPandas`` helpers where Spark SQL cannot express
the work (nearest-neighbour blocks, pluggable models).
"""

from passagekit.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
