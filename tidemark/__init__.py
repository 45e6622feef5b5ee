"""Spark-first analytics for event sessions, quote series and trade histories."""
