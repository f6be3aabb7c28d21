"""twinlens.functions"""
