"""Knowledge-catalog analytics on PySpark: entries, sections, items, links, search and spend as DataFrames."""
