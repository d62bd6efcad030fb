"""Stateless streams over the same transforms as batch."""
