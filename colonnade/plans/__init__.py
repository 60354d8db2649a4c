"""Filter expressions, their compilation to Spark columns, and plan trees."""
