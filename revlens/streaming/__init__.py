"""Incremental landing of raw files with Structured Streaming.

The study's batch stages hand files to each other; new review exports and
scrapes arrive as files.  ``landing.land_files`` turns a drop folder into a
bronze Parquet table incrementally: each file is read once (the stream
checkpoint records it), tagged, and written by micro-batch.  The reference
has no streaming queries (no windows, watermarks or state), so nothing
else lives here.
"""
