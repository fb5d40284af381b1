"""actlens.operators"""
