"""End-to-end batch runs that wire the operators together and write the results."""
