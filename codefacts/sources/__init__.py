"""Readers and writers of project trees and results."""

from .trees import load_tree, materialize_tree, read_by_project, write_error_text, write_failed_vectors, write_results_csv

__all__ = ["load_tree", "materialize_tree", "read_by_project", "write_error_text", "write_failed_vectors", "write_results_csv"]
