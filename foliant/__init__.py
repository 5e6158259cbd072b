"""A file-inventory, de-duplication and planning engine over Spark DataFrames."""
