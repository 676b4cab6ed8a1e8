"""Procedure-record analytics expressed as Spark plans."""
