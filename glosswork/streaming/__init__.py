"""The same work on streams.

Every function takes and returns streaming DataFrames, so a run is one
Structured Streaming query with a built-in sink. The batch operators that are
projections (triage, inference, audit) are used unchanged.
"""
