"""Marketplace analytics as plain Spark DataFrame functions.

Layout:

``sources``    readers, writers and the views over the test tables
``functions``  column expressions (text, scalars, exact quantiles, context)
``operators``  DataFrame -> DataFrame building blocks
``plans``      the business questions, composed from operators
``streaming``  Structured Streaming variants
"""
