"""kumiki.streaming"""
