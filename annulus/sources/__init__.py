"""Readers and sinks on Spark scans."""
