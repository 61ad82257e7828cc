"""Training-data operators: packing, sharding, tokenising, filtering and near-duplicate search.

Nothing else in the library imports this subpackage; it imports nothing from the rest.
"""
