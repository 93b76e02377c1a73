"""leadloom: lead extraction over stored web pages and documents, on Spark DataFrames."""
