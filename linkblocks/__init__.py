"""Approximately independent correlation blocks along an ordered axis, as Spark DataFrame transformations.

Every operator takes and returns frames of fixed schemas keyed by `chrom`, so
all chromosomes run in one job.
"""
