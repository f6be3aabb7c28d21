"""twinlens.sources"""
