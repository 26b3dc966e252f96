"""The projected network, the query catalog and its SQL."""
