"""Readers and writers. Readers take paths that Spark can open; parsers that need order are UDFs over whole small files."""
