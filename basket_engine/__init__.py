"""User/item behavior analytics on Spark DataFrames.

Sub-packages
------------
sources    readers: delimited text, dated directories, examples, reviews, models
sinks      writers: examples, results, exports, model rows
functions  column expressions without a shuffle
operators  DataFrame -> DataFrame operators (joins, aggregates, sequences, fit)
plans      the four end-to-end pipelines built from the operators
catalog    the registered queries over the star-schema tables, with their SQL
"""

__version__ = "0.1.0"
