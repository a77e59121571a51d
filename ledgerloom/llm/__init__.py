"""Operators for preparing training corpora, one module each; nothing else in the library imports this subpackage."""
