"""Incremental forms of batch operators. The batch operators define the results; a stream read to its end gives the same."""
