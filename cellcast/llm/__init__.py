"""Training-data operators: scans, counts, joins, archives and models over text corpora.

Every operator takes DataFrames and returns DataFrames.  The registered queries
(``registry.QUERIES``) bind them to the given tables with production parameters.
Nothing outside this package imports it; only the entry module adds its queries
when the package is present.
"""
