"""Injected providers: the only outside compute."""
