"""tidelex: time-stamped text events on Spark.

Ingest, repair, cleaning, scoring, serving queries and reconciliation for
time-stamped text events, written as DataFrame functions and Structured
Streaming jobs.
"""

__version__ = "0.1.0"
