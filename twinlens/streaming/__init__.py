"""twinlens.streaming"""
