"""A Spark-first engine for ordered tables: one lazy plan per query."""
