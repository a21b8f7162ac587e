"""Training-data operators: cleaning, deduplication, sharding and formatting of text corpora.

Every operator takes and returns DataFrames.  Nothing else in the library imports this package.
"""
