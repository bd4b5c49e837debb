"""flipgraph: counterfactual graph explanations and their analytics on Spark.

Layout: ``sources`` reads and writes, ``functions`` holds column expressions,
``operators`` holds DataFrame operators, ``plans`` holds the named queries with
their SQL twins, ``streaming`` holds the structured streaming monitor.
"""

__version__ = "0.1.0"
