"""Relational operators over sparse matrices and graphs."""
