"""Operators for preparing training corpora. Nothing else in millrace imports this subpackage."""
