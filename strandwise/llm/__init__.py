"""Training-data operators on DataFrames; nothing else in the library imports this subpackage."""
