"""Views of the given tables in the data model of the operators."""
