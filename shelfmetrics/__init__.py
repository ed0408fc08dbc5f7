"""Retail sales and inventory analytics expressed as Spark DataFrame plans."""
