"""Incremental loads with Structured Streaming.

The original load appends whole extracts with a batch job, so re-running it
doubles the rows.  :func:`grantrisk.streaming.append_load.stream_extracts`
re-expresses that append load as a file stream: every new extract file in a
folder is parsed, typed and appended exactly once (the checkpoint records
which files were committed), and ``availableNow`` runs it as a bounded job.
There is no other streaming in the reference workload.
"""
