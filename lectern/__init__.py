"""Lectern: document intelligence and retrieval as Spark DataFrame plans."""
