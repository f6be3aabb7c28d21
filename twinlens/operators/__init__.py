"""twinlens.operators"""
