"""Operators on tables of files, pages, paragraphs and images."""
