"""Reading and writing of the formats that corpora come in. Parquet is for all that is kept."""
