"""Training-data operators: dedup, scans, scoring, sharding and mixing.

Nothing outside this subpackage imports it; the driver entry file adds its
queries only when it can be imported.
"""
