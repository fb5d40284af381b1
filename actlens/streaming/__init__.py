"""actlens.streaming"""
