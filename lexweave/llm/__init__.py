"""Training-data operators over document, page, conversation and embedding tables.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
