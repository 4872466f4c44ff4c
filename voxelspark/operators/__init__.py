"""Relational and kernel operators over volumes, graphs and skeletons."""
