"""DataFrame-to-DataFrame operators. None collects, none uses a Python UDF."""
