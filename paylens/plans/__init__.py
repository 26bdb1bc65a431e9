"""Whole jobs made of sources and operators."""
