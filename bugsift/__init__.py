"""bugsift: text-mining operators for collections of short reports, on Spark.

Every operator is a function from DataFrame(s) to DataFrame built on Spark SQL
and MLlib; see README.md for the map from operators to modules.
"""

__version__ = "0.1.0"
