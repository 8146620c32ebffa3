"""kumiki.sources"""
