"""Training-data operators: filtering, deduplication, tokenising, packing and archives.

Each module holds one operator; ``queries`` binds them to the test tables.  Nothing else in
the library imports this subpackage.
"""
