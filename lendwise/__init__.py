"""lendwise: consumer-lending analytics on Spark DataFrames.

Every operator is a function of DataFrames (plus column names and
parameters) returning a DataFrame; nothing is collected to the driver
except one-row scalars that Spark itself computes.
"""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
