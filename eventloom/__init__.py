"""An analytics engine for event streams, native to PySpark."""

VERSION = "0.2"
