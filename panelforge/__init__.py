"""Analytics over panels of periodic asset returns, expressed as Spark DataFrames.

``sources`` read and write, ``functions`` build column expressions, ``operators`` map DataFrames to
DataFrames, ``plans`` chain operators into jobs, ``streaming`` runs some of them over streams.
"""
