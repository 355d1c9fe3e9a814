"""polyrisk: exposure/outcome combination analytics on Spark.

Subpackages: ``sources`` (inputs), ``operators`` (DataFrame operators),
``functions`` (column expressions), ``ml`` (distributed model fitting),
``plans`` (workflows, registered queries and their SQL twins),
``sinks`` writes outputs.
"""

__version__ = "0.1.0"
