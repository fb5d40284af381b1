"""actlens.sources"""
