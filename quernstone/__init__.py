"""Quernstone: document retrieval and grounded answering on Spark DataFrames."""
