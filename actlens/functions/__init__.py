"""actlens.functions"""
