"""kumiki.operators"""
