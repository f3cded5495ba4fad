"""Readers: text, JSON and XML forms of graphs, histories and matrices as frames."""
