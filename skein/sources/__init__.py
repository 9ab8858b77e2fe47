"""Tables in and out: adapters, ingest formats, Parquet layouts."""
