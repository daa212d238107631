"""Printed titles of documents, found with DataFrame operations over positioned lines."""
