"""twinlens.plans"""
