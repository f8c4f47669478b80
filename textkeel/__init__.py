"""textkeel: text-safety scanning, redaction and corpus preparation on Spark DataFrames."""
