"""Website quality and search performance analytics as Spark jobs.

Every operator takes and returns DataFrames (or Columns), covers all sites in one job and leaves
physical strategy to Catalyst and adaptive execution.
"""
