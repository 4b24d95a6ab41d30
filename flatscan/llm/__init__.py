"""Training-data operators: deduplication, filtering, scoring and archive writing.

Every operator takes a DataFrame and returns a DataFrame; nothing else in the
library imports this subpackage.
"""
