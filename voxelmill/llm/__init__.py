"""Training-data operators: thirteen text and vector operators and their registered queries.

Nothing outside this subpackage imports it. Each module holds one operator with a general
interface; ``queries`` applies them to the given tables.
"""
