"""loadscope: athlete workload and injury-risk analytics as Spark DataFrame operators.

Every public operator is a plain function ``op(df, ...) -> DataFrame`` built from
Catalyst expressions, windows, joins and Spark ML, usable through ``df.transform``.
"""

__version__ = "0.1.0"
