"""Column functions: text rules, vector products and score ladders, all of Spark built-ins."""
