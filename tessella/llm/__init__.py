"""Training-data operations: ten operators and the queries that apply them.

Nothing outside this package imports it; it can be deleted without harm to
the rest of the library.
"""
