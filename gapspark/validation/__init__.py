"""Annotation studies: protocol, annotators, agreement and comparison statistics."""
