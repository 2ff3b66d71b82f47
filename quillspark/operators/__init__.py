"""Physical and logical operators over DataFrames."""
