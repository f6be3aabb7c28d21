"""twinlens.kernels"""
