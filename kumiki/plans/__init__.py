"""kumiki.plans"""
