"""Curation and evaluation of labelled message collections on Spark."""
