"""Network-flow analytics as Spark DataFrame and Structured Streaming jobs.

Packets (time, five-tuple, length) come in as tables, capture files or streams;
they are aggregated into flows, kept as cumulative snapshots, and questioned for
totals, lifecycles, heavy hitters and super spreaders. Every operator takes and
returns DataFrames.
"""
