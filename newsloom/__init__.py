"""newsloom: news and announcement aggregation as Spark DataFrame jobs.

Landed feeds and pages go in; a deduplicated, windowed, enriched and searchable
item table comes out.  Every public operator is a plain function from
DataFrames (and parameters) to a DataFrame, or from Columns to a Column.
"""
