"""Columnade: SQL expressions compiled to native Spark columns, and the operators around them."""
