"""Keyloom: keyed data structures as set-oriented Spark operators."""
