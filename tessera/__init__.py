"""Tessera: labelled examples, activation tables and linear readouts as Spark DataFrame operations."""
