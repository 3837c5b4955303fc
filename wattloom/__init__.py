"""Spark jobs over simulated building-energy stock data, and over text corpora in ``wattloom.llm``."""
