"""Spark jobs that segment gridded point data into phases by noise-weighted factors."""
