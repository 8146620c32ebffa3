"""kumiki.functions"""
