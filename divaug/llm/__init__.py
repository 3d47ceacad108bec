"""Training-data operators and their registered queries.

Nothing else in the library imports this subpackage; the entry module adds
its queries when it is present.
"""
