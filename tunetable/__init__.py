"""Instruction-tuning data preparation and evaluation analytics on Spark DataFrames.

``functions``  Column -> Column helpers (text, prompts, quality rules, formats)
``operators``  DataFrame -> DataFrame jobs (sampling, metrics, reports, telemetry, usage, frames)
``sources``    readers, writers and small constant tables
``streaming``  Structured Streaming versions of the log and token-frame jobs
``plans``      the registered queries, their input views and the equivalent SQL
"""
