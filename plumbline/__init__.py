"""plumbline: data-quality and query-behaviour analytics as Spark jobs.

Every operator takes and returns DataFrames; nothing is collected to the driver.
"""
