"""Stance analytics for financial text, expressed as Spark DataFrame operators."""
